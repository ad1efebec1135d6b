import base64
import gzip
import hashlib
import io
import zlib

import pytest

from llm import warc

SCHEMA = "page_id long, url string, html string, digest string, last long"


def plan(rows):
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(i, last.get(h or "", i))
    out = []
    for i, u, h in rows:
        if i is not None:
            raw = (h or "").encode()
            again = len(raw) >= 1000 and last[h or ""] > i
            out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h or ""] if again else None))
    return sorted(out)


def test_archives_give_back_what_was_planned(spark):
    big, long = "<p>é</p>" * 200, "x" * 3_000_000
    rows = [(1, "http://a/b?c=d", big), (2, None, big), (3, "http://x y\r\nInjected: 1", "<html>"), (4, "u", None), (5, "u", ""),
            (6, "u", "<html>"), (7, "", big), (8, "u", long), (9, "u", long), (None, "u", big), (7, "again", big), (10, "u", "\r\n\r\nWARC/1.1")]
    files, folder = warc.write(spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA).repartition(4))
    got = warc.read(files, folder).collect()
    assert sorted(tuple(r)[:5] for r in got) == plan(rows)
    assert {r["url"] for r in got if r["page_id"] == 3} == {"http://x%20y%0D%0AInjected:%201"}
    assert files.agg({"records": "sum"}).first()[0] == len(got)
    fs, path = warc.filesystem(files.first()["path"])
    raw = fs.open_input_stream(path, compression=None).read()
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\n"), "a plain gzip reader can open a file"


def stream(*records):
    return io.BytesIO(b"".join(records))


def test_reader_goes_record_by_record_and_verifies(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 11)
    sha = lambda b: hashlib.sha1(b).hexdigest()
    one, two = (warc.record(i, "u", p, sha(p), None) for i, p in ((1, b"payload " * 40), (2, b"")))
    back = warc.record(3, None, b"payload " * 40, sha(b"payload " * 40), 1)
    assert [h["warc-type"] for h, _, _ in warc.records(stream(one, two, back))] == ["response", "response", "revisit"]
    assert [p for _, _, p in warc.records(stream(one, two, back))] == [b"payload " * 40, b"", b""]
    reader = warc.records(stream(one, two[:-9]))
    assert next(reader)[2] == b"payload " * 40
    with pytest.raises((ValueError, zlib.error)):
        next(reader)

    def changed(old, new):
        return zlib.compress(zlib.decompress(one, 31).replace(old, new), wbits=31)

    for bad in (changed(b"payload payload", b"payload PAYLOAD"), changed(b"Content-Length: 320", b"Content-Length: 3"),
                changed(base64.b32encode(bytes.fromhex(sha(b"payload " * 40))), b"A" * 32), changed(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            list(warc.records(stream(bad)))


def test_no_rows(spark):
    assert warc.read(*warc.write(spark.createDataFrame([], SCHEMA))).count() == 0
