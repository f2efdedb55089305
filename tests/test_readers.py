"""Links of untidy pages; digests of files in ranges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import html as H
from lexquarry.sources import tables as R


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<a href=/x/1>one</a>", [("/x/1", "one")]),
        ("<A HREF='/q?a=1&amp;b=2' >Tom &amp; J&eacute;r&#244;me</A>", [("/q?a=1&b=2", "Tom & Jérôme")]),
        ('<!-- <a href="/no">no</a> --><a href="/yes">y<b>e</b>s\n  <i>!</i></a>', [("/yes", "y e s !")]),
        ('<script>document.write("<a href=\'/no\'>no</a>")</script><a href=" /s ">s</a>', [("/s", "s")]),
        ('<a name="x">no</a><a href>empty</a><a data-href="/no" href="/a">a<a href="/b">b</a> after', [("/a", "a"), ("/b", "b")]),
        ('<a title="a > b" href="/t">t</a>', [("/t", "t")]),
        ('<a href="/open">to the end', [("/open", "to the end")]),
        ('<a href="/img"><img src="x"/>pic<script>no()</script></a>', [("/img", "pic")]),
        ("no links <", []),
        ("", []),
        (None, []),
    ],
)
def test_links(spark, page, expected):
    got = spark.createDataFrame([(page,)], "t string").select(H.links(F.col("t")).alias("x")).first().x
    assert [tuple(x) for x in got] == expected


def test_digests_in_ranges(spark, tmp_path):
    made = {"a b.pdf": b"x" * 1000, "sub/ü%20.pdf": bytes(range(256)) * 4, "empty.pdf": b"", ".hidden.pdf": b"h", "~$lock.pdf": b"l", "other.txt": b"t"}
    (tmp_path / "sub").mkdir()
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    kept = {n: c for n, c in made.items() if c and n.endswith(".pdf") and not n.startswith((".", "~$"))}
    for step in (7, R.DIGEST_BYTES):
        got = {r.path.split(tmp_path.name + "/")[1]: (r.length, r.sha256) for r in R.files(spark, str(tmp_path), step=step).collect()}
        assert sorted(got.values()) == sorted((len(c), hashlib.sha256(c).hexdigest()) for c in kept.values())
    assert [r.length for r in R.files(spark, str(tmp_path), most=1).collect()] == [1000]
