import hashlib
import io

import zstandard

from tallyhouse.llm import registry, warc


def pages(spark):
    big, other = "é<p>" * 60, "z" * 400
    rows = [(1, "u1", big), (2, "u2", big), (0, None, other), (3, "u\r\n3", ""), (4, "u4", None), (5, "u5", "short"), (6, "u6", "short"), (None, "u7", big), (2, "u2", big), (1, "u1", big), (9, "u9", "x\r\n\r\nWARC/1.1" * 30)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string"), rows


def test_round_trip(spark, tmp_path):
    df, rows = pages(spark)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in registry.op10_warc(spark, str(tmp_path)).collect()), key=str)
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(html) if first.get(html) != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=str)


def test_files_seek_and_fetch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(200)], "page_id bigint, url string, html string")
    bundles = warc.write_bundles(warc.records(df), f"{tmp_path}/b", frame_bytes=4000, bundle_bytes=3000)
    for row in bundles.collect():
        data = bytes(row.data)
        table = warc.seek_table(data)
        assert len(table) > 1
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert len(whole) == sum(raw for _, _, raw in table)
        for r in row.records:
            at, packed, raw = table[r.frame]
            frame = zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=raw)
            assert f"<urn:page:{r.page_id}>".encode() in frame[r.offset : r.offset + r.length]
    found = warc.fetch(bundles, spark.createDataFrame([(3,), (77,), (77,), (None,), (999,)], "page_id bigint")).collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in found} == {(i, f"<p>{i}</p>" * 50) for i in (3, 77)}
    assert warc.index(bundles).count() == 200


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_bundles(warc.write_bundles(warc.records(df), f"{tmp_path}/e")).count() == 0


def strict_records(data):
    """(fields, block) of each record, by the grammar of WARC/1.1: version line, fields, blank line, block, two line ends."""
    at, found = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        assert version == "WARC/1.1" and all(": " in x for x in lines)
        fields = dict(x.split(": ", 1) for x in lines)
        assert len(fields) == len(lines)
        block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
        at = end + 4 + len(block) + 4
        assert data[at - 4 : at] == b"\r\n\r\n"
        found.append((fields, block))
    return found


def test_files_by_a_strict_reader(spark, tmp_path):
    df, rows = pages(spark)
    found = []
    for row in warc.write_bundles(warc.records(df), f"{tmp_path}/b", date="2024-05-06T07:08:09Z").collect():
        found += strict_records(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(row.data)), read_across_frames=True).read())
    assert len(found) == len(rows) and len({f["WARC-Record-ID"] for f, _ in found}) == len(rows)
    for fields, block in found:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Length"} <= set(fields) and fields["WARC-Date"] == "2024-05-06T07:08:09Z"
        assert fields["WARC-Record-ID"].startswith("<urn:uuid:") and not any(c in fields["WARC-Target-URI"] for c in " <>\r\n")
        if fields["WARC-Type"] == "response":
            head, payload = block.split(b"\r\n\r\n", 1)
            assert head.startswith(b"HTTP/1.1 200 OK\r\n") and f"sha256:{hashlib.sha256(payload).hexdigest()}" == fields["WARC-Payload-Digest"]
        else:
            assert fields["WARC-Profile"].endswith("identical-payload-digest") and block == b"" and fields["WARC-Refers-To-Target-URI"] in {"u1", "urn:page:0"}


def test_other_columns_large_and_hot_payloads(spark, tmp_path, monkeypatch):
    from tallyhouse.llm import common

    monkeypatch.setattr(common, "HOT_COPIES", 20)
    rows = [(i, f"u{i}", "hot " * 50 if i % 3 else f"own {i} " * 30, "d", 1, "f") for i in range(90)] + [(90, None, "é" * 2_000_000, "d", 1, "f")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string, copies int, first string")
    out = warc.read_bundles(warc.write_bundles(warc.records(df), f"{tmp_path}/b")).collect()
    assert {r.page_id: r.refers_to for r in out} == {i: 1 if i % 3 and i > 1 and i < 90 else None for i in range(91)}
    assert next(bytes(r.payload).decode() for r in out if r.page_id == 90) == "é" * 2_000_000 and {r.url for r in out if r.page_id == 90} == {None}
