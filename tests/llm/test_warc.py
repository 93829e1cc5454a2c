import gzip
import hashlib
import io

import pytest
from tidemark.llm import warc

PAGES = "page_id long, url string, html string, payload string"


def rows():
    big = "<p>" + "größe " * 50 + "</p>"
    out = [(i, f"http://h/{i}", f"<html>{i} " + "x" * (i * 37 % 900) + "</html>", "clash") for i in range(120)]
    out += [(500 + i, f"http://d/{i} a\nb", big, None) for i in range(40)]
    out += [(700, None, None, None), (701, "u", "", None), (None, "n", big, None), (None, "m", "z" * 200, None), (800, "s", "short", None), (801, "s", "short", None), (0, "again", "<html>0 </html>", None)]
    return out + [(900, "long", "é" * 700_000, None)]


def brute(rows):
    first = {}
    for p, _, h, _ in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= 100:
            first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h, _ in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = f is not None and f != p
        out.append((str(p), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [997, 40_000, warc.SPLIT])
def test_round_trip_for_any_split(spark, split, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", 20_000)
    r = rows()
    manifest = warc.write_archive(spark.createDataFrame(r, PAGES).repartition(3))
    got = warc.read_archive(manifest, split=split).collect()
    assert sorted(((str(x["page_id"]), x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got), key=str) == brute(r)
    html = {}
    for p, _, h, _ in r:
        html.setdefault(p, set()).add(h or "")
    assert all(x["payload"].decode() in html[x["page_id"]] for x in got if x["record_type"] == "response")


def test_standard_tools_read_the_members(spark):
    manifest = warc.write_archive(spark.createDataFrame(rows()[:30], PAGES).coalesce(1)).collect()
    data = open(manifest[0]["path"].removeprefix("file://"), "rb").read()
    assert gzip.GzipFile(fileobj=io.BytesIO(data)).read().count(b"WARC/1.1\r\n") == 30


def test_false_magic_is_not_a_record():
    member = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    noise = warc.MAGIC + b"\x00" * 40 + gzip.compress(b"not a record") + warc.MAGIC[:2]
    data = noise + member + member
    got = list(warc.records_in(io.BytesIO(data), 0, len(data), len(data), chunk=16))
    assert [warc.parse(x)["page_id"] for x in got] == [1, 1]
    assert len(list(warc.records_in(io.BytesIO(data), len(noise) + 1, len(data), len(data)))) == 1


def test_salted_join_and_empty(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    r = rows()
    got = warc.round_trip(spark.createDataFrame(r, PAGES)).collect()
    assert sorted(((str(x[0]), *x[1:]) for x in got), key=str) == brute(r)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
