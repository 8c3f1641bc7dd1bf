"""Files read in several ranges."""

import numpy as np
import pytest

from tessera.sources import stl


def binary(n):
    records = np.zeros(n, stl._RECORD)
    records["numbers"][:, 3:] = np.random.default_rng(2).normal(size=(n, 9)).astype("<f4")
    return b"\0" * 80 + n.to_bytes(4, "little") + records.tobytes()


def text(n, name="a facet of"):
    rng = np.random.default_rng(4)
    blocks = []
    for i in range(n):
        a, b, c = (" ".join(map(repr, map(float, p))) for p in rng.normal(size=(3, 3)).round(i % 7))
        blocks.append(f"  Facet normal 0 0 0\n outer loop\n vertex {a}\n vertex {b}\n\tvertex {c}\n endloop\n endfacet\n" + " " * (i % 5))
    return (f"solid {name}\n" + "".join(blocks) + "endsolid facet\n").encode()


def pieces(content, split):
    def read(offset, size):
        return content[offset : offset + size]

    return np.concatenate([stl.parse_range(read, *r) for r in stl.plan_ranges(read, len(content), split)])


@pytest.mark.parametrize("split", [1, 3, 50, 51, 97, 400, 5000, 10**6])
@pytest.mark.parametrize("content", [binary(40), text(40)], ids=["binary", "text"])
def test_any_split_equals_the_whole(content, split):
    assert (pieces(content, split) == stl.parse_stl(content)).all()


def test_broken_files_raise_in_ranges():
    good = text(6)
    wrong = [
        good.replace(b"endsolid", b"endsolids"), good + b"more words", good.replace(b"endloop", b"endlop", 1), good.replace(b"\n  Facet", b"\nx Facet", 1),
        good.replace(b" outer", b" facet outer", 1), b"solid x\n \nendsolid x", binary(5)[:-1], good.replace(b"endfacet", b"endsolid\nsolid", 1), binary(3).replace(binary(3)[96:100], b"\0\0\xc0\x7f"),
    ]
    for content in wrong:
        for split in (60, 10**6):
            with pytest.raises(ValueError):
                pieces(content, split)


def test_spark_reads_ranges_in_several_tasks(spark, tmp_path):
    (tmp_path / "a.stl").write_bytes(binary(60))
    (tmp_path / "b c.stl").write_bytes(text(30))
    (tmp_path / "d.stl").write_bytes(binary(3))
    whole = stl.read_stl(spark, str(tmp_path))
    split = stl.read_stl(spark, str(tmp_path), 500)
    assert split.rdd.getNumPartitions() > 6
    assert sorted(split.collect()) == sorted(whole.collect()) and whole.count() == 93
    for name, content in (("empty", b""), ("cut", binary(60)[:-9]), ("none", binary(0))):
        (tmp_path / f"{name}.bad").write_bytes(content)
        with pytest.raises(Exception, match="STL|no facets"):
            stl.read_stl(spark, str(tmp_path / f"{name}.bad"), 100).collect()
    with pytest.raises(Exception, match="(?i)path"):
        stl.read_stl(spark, str(tmp_path / "missing.stl"))
