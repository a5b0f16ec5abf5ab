"""Patterns of paths against pathlib on a generated tree."""

import random

import pytest

from loomkb.sources import files

PATTERNS = ["**/*.go", "*.md", "a/**/*.go", "a/*/x?.go", "**", "b/**", "a/**/c/*", "**/c/**/*.md", "*/[ab]*/**/*.go", "**/[!x]*.md", "none/**/*.go", "a b/*.md", "**/x1.go", "**/p+q.md"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("tree"), random.Random(6)
    for _ in range(400):
        place = root.joinpath(*rng.choices(["a", "b", "c", "ab", "a b"], k=rng.randint(0, 4)))
        place.mkdir(parents=True, exist_ok=True)
        (place / rng.choice(["x1.go", "x22.go", "y.go", "x.md", "r.md", "p+q.md", "ppq.md", "nogo"])).write_text("t")
    return root


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_as_pathlib(spark, tree, pattern):
    want = sorted({p.relative_to(tree).as_posix() for p in tree.glob(pattern) if p.is_file()})  # pathlib repeats some
    assert sorted(r["relative"] for r in files.glob_files(spark, str(tree), pattern).collect()) == want
    assert want or pattern.startswith("none")
