import base64
import hashlib
import io

import pytest

from pagewright.llm import warc

SCHEMA = "page_id long, url string, html string, uri string, records int, at int, doc int, _metadata int"
ROWS = [(1, "http://a/x y\r\nEvil: 1", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "u", ""), (5, "ü", "x" * 300_000), (6, "v", "ein\r\n\r\nzwei ü"), (7, "w", "<p>same</p>"), (7, "w", "<p>same</p>"), (None, "n", "<p>same</p>"), (None, "n", "alone")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, 3, 4) for r in rows], SCHEMA)


def brute(rows, least=0):
    out = []
    for p, _, h in rows:
        body = (h or "").encode()
        same = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
        revisit = bool(same) and len(body) >= least and (p is None or p < max(same))
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1, 1 << 10, 1 << 24])
def test_round_trip(spark, size):
    found = warc.read(warc.write(pages(spark, ROWS), config=warc.Config(archive_bytes=size)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(ROWS)


def test_small_payloads_are_responses_and_empty_tables_write_nothing(spark):
    found = warc.read(warc.write(pages(spark, ROWS), config=warc.Config(revisit_least=100)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(ROWS, 100)
    made = warc.write(pages(spark, []))
    assert made.count() == 0 and warc.read(made).count() == 0


def test_names_of_records(spark):
    """Every record has a name of its own, repeated and null pages too; revisits name the response."""
    import re

    from pyarrow import fs

    names, types, refers = [], {}, []
    for r in warc.write(pages(spark, ROWS)).collect():
        system, path = fs.FileSystem.from_uri(r["uri"])
        with system.open_input_stream(path) as stream:
            for raw in warc.records_of(stream):
                name, kind = re.search(rb"WARC-Record-ID: (\S+)", raw)[1], re.search(rb"WARC-Type: (\S+)", raw)[1]
                names.append(name)
                types[name] = kind
                refers += re.findall(rb"WARC-Refers-To: (\S+)", raw)
    assert len(set(names)) == len(names) == len(ROWS) and refers and all(types[n] == b"response" for n in refers)


def test_archive_layout():
    bodies = [(b"<p>word %d </p>" % i) * 40 for i in range(200)]
    records = [warc.record(i, f"http://h/{i}", b, len(b), hashlib.sha1(b).hexdigest(), None, f"{i:032x}", "", "1970-01-01T00:00:00Z") for i, b in enumerate(bodies)]
    parts = list(warc.archive(records, warc.Config()))
    assert len(parts) == 201 and parts[0][:4] == bytes.fromhex("5d2a4d18")
    whole = b"".join(parts)
    assert list(warc.records_of(io.BytesIO(whole), 17)) == records
    import zstandard

    alone = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)
    assert len(whole) < alone  # the dictionary pays
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(whole[:-3])))
    with pytest.raises(ValueError):
        warc.parsed(records[3].replace(b"word 3", b"word 4"))
