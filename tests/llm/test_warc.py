import base64
import gzip
import hashlib
import io
import random

import pytest

from loomframe.llm import warc

PAGES = "page_id long, url string, html string, archive string, type string"


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def pages():
    r = random.Random(17)
    rows = [(i, f"http://x/{i}", r.choice(["same", "", "other \U0001f600"]) if i % 3 else f"<p>{i}\r\n\r\nWARC/1.1\r\n</p>") for i in range(60)]
    rows += [(100, None, None), (101, "http://a\r\nb%20é", "x" * 300_000), (102, "u", "\x1f\x8b\x08 no member")]
    return [(*row, "clash", "clash") for row in rows]


def brute(rows, least=0):
    top = {}
    for i, _, h, *_ in rows:
        top[h or ""] = max(top.get(h or "", i), i)
    out = {}
    for i, _, h, *_ in rows:
        h = h or ""
        again = len(h.encode()) >= least and top[h] != i
        out[i] = (len(h.encode()), sha(h), "revisit" if again else "response", str(top[h]) if again else None)
    return out


@pytest.mark.parametrize("least,size", [(0, 64 << 20), (5, 2000)])
def test_archives_read_back(spark, least, size):
    rows = pages()
    archives = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), least=least, archive_bytes=size)
    back = warc.read_archives(archives, payloads=True)
    found = back.filter("entry = 'record' AND type <> 'warcinfo'").withColumn("page", warc.page_id_of("record_id")).withColumn("to", warc.page_id_of("refers_to")).collect()
    assert {int(r["page"]): (r["payload_bytes"], r["payload_digest"], r["type"], r["to"]) for r in found} == brute(rows, least) and len(found) == len(rows)
    assert back.filter("entry = 'gap'").count() == 0
    by = {r[0]: r for r in rows}
    assert all(r["payload"].decode() == (by[int(r["page"])][2] or "") for r in found if r["type"] == "response")
    assert all(r["target_uri"] == by[int(r["page"])][1] for r in found)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)


def test_repeated_rows_nulls_and_empty_tables(spark):
    rows = [(1, "u", "a", "", ""), (1, "u", "a", "", ""), (None, "u", "a", "", ""), (2, "u", "b", "", "")]
    back = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES))).filter("type <> 'warcinfo'")
    got = sorted((str(r["p"]), r["type"], str(r["to"])) for r in back.select(warc.page_id_of("record_id").alias("p"), "type", warc.page_id_of("refers_to").alias("to")).collect())
    assert got == [("1", "response", "None"), ("1", "response", "None"), ("2", "response", "None"), ("None", "revisit", "1")]
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0


def members(n):
    raw = [warc.page_record(str(i), f"http://x/{i}", f"body {i} ".encode() * 50, warc.digest(f"body {i} ".encode() * 50), None) for i in range(n)]
    return raw, [warc.member(x) for x in raw]


def read(data):
    found = list(warc.salvage(io.BytesIO(data)))
    records = [x[2]["warc-record-id"] for x in found if x[0] == "record"]
    gaps = [x[1:3] for x in found if x[0] == "gap"]
    covered = sum(b - a for a, b in gaps)
    return records, gaps, covered


def test_sound_members_are_standard(tmp_path):
    raw, packed = members(3)
    assert gzip.decompress(b"".join(packed)) == b"".join(raw)
    assert read(b"".join(packed))[0] == [f"<urn:x-page:{i}>" for i in range(3)] == read(b"".join(raw))[0]
    assert read(b"") == ([], [], 0)


@pytest.mark.parametrize("damage", ["flip", "cut", "zeros", "junk between", "junk first", "junk last", "magic", "length"])
def test_later_records_are_salvaged_and_gaps_logged(damage):
    raw, packed = members(6)
    begin, size = len(b"".join(packed[:2])), len(packed[2])
    parts = list(packed)
    if damage == "flip":
        parts[2] = parts[2][:40] + bytes([parts[2][40] ^ 0xFF]) + parts[2][41:]
    elif damage == "cut":
        parts[2] = parts[2][: size // 2]
    elif damage == "zeros":
        parts[2] = bytes(size)
    elif damage == "magic":
        parts[2] = b"\x1f\x8b\x08" * 50
    elif damage == "length":
        parts[2] = warc.member(raw[2].replace(b"Content-Length: ", b"Content-Length: 9", 1))
    else:
        at = {"junk between": 2, "junk first": 0, "junk last": 6}[damage]
        junk = b"\x1f\x8b\x08 not one WARC/1. nor this " * 20
        found, gaps, covered = read(b"".join([*parts[:at], junk, *parts[at:]]))
        assert found == [f"<urn:x-page:{i}>" for i in range(6)] and covered == len(junk) and len(gaps) == 1
        return
    found, gaps, covered = read(b"".join(parts))
    assert found == [f"<urn:x-page:{i}>" for i in (0, 1, 3, 4, 5)]
    assert gaps == [(begin, begin + len(parts[2]))] and covered == len(parts[2])


def test_plain_archives_are_salvaged_too():
    raw, _ = members(5)
    bad = raw[1].replace(b"body 1", b"BODY 1", 1)
    found, gaps, _ = read(raw[0] + bad + raw[2] + b"xx" + raw[3] + raw[4][:-30])
    assert found == [f"<urn:x-page:{i}>" for i in (0, 2, 3)]
    assert gaps[0] == (len(raw[0]), len(raw[0] + bad)) and len(gaps) == 3


def test_damage_anywhere_loses_no_more_than_what_it_hits():
    _, packed = members(8)
    whole = b"".join(packed)
    r = random.Random(18)
    ends = [len(b"".join(packed[: k + 1])) for k in range(8)]
    for _ in range(200):
        at = r.randrange(len(whole))
        found, gaps, _ = read(whole[:at] + bytes([whole[at] ^ (1 << r.randrange(8))]) + whole[at + 1 :])
        hit = next(k for k, e in enumerate(ends) if at < e)
        assert set(f"<urn:x-page:{k}>" for k in range(8) if k != hit) <= set(found) and len(gaps) <= 1


def test_several_records_a_member():
    raw, packed = members(9)
    together = warc.member(b"".join(raw[1:5]))
    assert read(packed[0] + together + packed[5])[:2] == ([f"<urn:x-page:{i}>" for i in range(6)], [])
    # A record damaged within a sound member costs itself alone; the gap names the member.
    inside = warc.member(raw[1] + raw[2].replace(b"body 2", b"BODY 2", 1) + raw[3])
    found, gaps, _ = read(packed[0] + inside + packed[5])
    assert found == [f"<urn:x-page:{i}>" for i in (0, 1, 3, 5)] and gaps == [(len(packed[0]), len(packed[0]) + len(inside))]
    # A whole archive in one member that breaks off: all but what the break hits.
    r = random.Random(4)
    many = [warc.page_record(str(i), None, (p := r.randbytes(100_000)), warc.digest(p), None) for i in range(20)]
    whole = warc.member(b"".join(many))
    found, gaps, _ = read(whole[: len(whole) * 3 // 4] + packed[0])
    assert found[:13] == [f"<urn:x-page:{i}>" for i in range(13)] and found[-1] == "<urn:x-page:0>" and len(gaps) == 1


def test_memory_stays_bounded_after_damage(monkeypatch):
    r = random.Random(6)
    packed = [warc.member(warc.page_record(str(i), None, (p := r.randbytes(60_000)), warc.digest(p), None)) for i in range(1150)]
    data = b"junk" + b"".join(packed[:3]) + b"\x00" * 100 + b"".join(packed[3:])
    assert len(data) > 64 << 20
    most, need = [0], warc._Bytes.need

    def watched(self, end):
        found = need(self, end)
        most[0] = max(most[0], len(self.held))
        return found

    monkeypatch.setattr(warc._Bytes, "need", watched)
    found, gaps, covered = read(data)
    assert len(found) == 1150 and covered == 104 and most[0] < 3 << 20


def test_every_archive_is_a_task(spark):
    rows = [(i, f"u{i}", f"page {i} " * 20) for i in range(200)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), archive_bytes=1)
    assert archives.count() == 200
    back = warc.read_archives(archives)
    parts = back.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(parts) == 200


def test_a_payload_of_many_copies(spark):
    rows = spark.range(50_000).selectExpr("id AS page_id", "concat('u', id) AS url", "IF(id % 3 = 0, 'the common page', concat('page ', id)) AS html")
    back = warc.read_archives(warc.write_archives(rows)).filter("type <> 'warcinfo'")
    got = {r["type"]: r["n"] for r in back.groupBy("type").count().withColumnRenamed("count", "n").collect()}
    again = (50_000 + 2) // 3 - 1
    assert got == {"revisit": again, "response": 50_000 - again}
    assert [r[0] for r in back.select("refers_to").distinct().dropna().collect()] == ["<urn:x-page:49998>"]
