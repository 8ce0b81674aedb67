import base64
import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
from tierflow.llm.warc import read_archives, round_trip, write_archives

PAGES = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://a/", "same"),
    (5, "http://b/\r\nEvil: yes", "same"),
    (3, "http://c/%41", "ünïque\r\n\r\nWARC/1.1\r\n\r\n" * 50),
    (4, None, ""),
    (6, "http://d/", None),
    (None, "http://e/", "same"),
    (7, "http://f/", "x" * 300_000),
    (8, "http://g/", "twin"),
    (8, "http://g/", "twin"),
    (8, "http://h/", "other"),
]


def records(spark, rows=ROWS):
    df = spark.createDataFrame(rows, PAGES)
    return df.selectExpr("page_id AS id", "url", "html AS payload")


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_bytes_come_back(spark, work, chunk):
    manifest = write_archives(records(spark), work, chunk_bytes=chunk, archive_bytes=500)
    rows = read_archives(manifest, chunk_bytes=chunk).collect()
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.chunk):
        if r.record_type == "response":
            whole[r.record_id, r.url].append(bytes(r.data))
            assert len(r.data) <= chunk
            so_far = b"".join(whole[r.record_id, r.url])
            assert r.bytes_so_far == len(so_far)
            assert r.digest_so_far == base64.b32encode(hashlib.sha1(so_far).digest()).decode()
    got = {key: b"".join(data).decode() for key, data in whole.items()}
    expected = {(doc, url): html or "" for doc, url, html in ROWS if doc in (3, 5, 6, 7, 8)}
    assert got == expected
    ends = [r for r in rows if r.chunks_end]
    assert len(ends) == len(ROWS) == sum(r.records for r in manifest.collect())


def test_archives_are_gzip_members_of_records(spark, work):
    manifest = write_archives(records(spark), work)
    bodies = [gzip.decompress(Path(r.path).read_bytes()) for r in manifest.collect()]
    assert all(b.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") for b in bodies)
    assert sum(b.count(b"WARC-Type: revisit") for b in bodies) == 4
    assert not any(b"\r\nEvil: yes" in b for b in bodies)
    for body in bodies:
        for line in body.split(b"\r\n"):
            if line.startswith(b"WARC-Target-URI"):
                assert b"\n" not in line


def test_a_damaged_payload_is_noticed(spark, work):
    manifest = write_archives(records(spark, [(1, "u", "payload")]), work)
    (row,) = manifest.collect()
    path = Path(row.path)
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"payload\r", b"pAyload\r")))
    with pytest.raises(Exception, match="has digest"):
        read_archives(manifest).collect()
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes())[:-20]))
    with pytest.raises(Exception, match="ends within"):
        read_archives(manifest).collect()


@pytest.mark.parametrize("sent", [0, 1 << 20])
def test_equals_brute_force(spark, sent):
    sizes = {"chunk_bytes": 1000, "broadcast_bytes": sent}
    got = round_trip(spark.createDataFrame(ROWS, PAGES), **sizes).collect()
    winner = {}
    for doc, _, html in ROWS:
        winner[html or ""] = max(winner.get(html or "", -1), -1 if doc is None else doc)
    expected, seen = [], set()
    for doc, _, html in ROWS:
        body = (html or "").encode()
        first = doc == winner[html or ""] and (doc, html) not in seen
        seen.add((doc, html))
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        kind = "response" if first else "revisit"
        expected.append((doc, len(body), digest, kind, None if first else winner[html or ""]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_short_payloads_are_all_responses(spark):
    got = round_trip(spark.createDataFrame(ROWS, PAGES), least_bytes=5).collect()
    assert [r.record_type for r in got] == ["response"] * len(ROWS)


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], PAGES)).count() == 0
