"""JSON arrays read by byte ranges, against a whole reading of the same file."""

import hashlib
import json
import random

import pytest

from tallyhouse.operators.parsing import InputError, input_fingerprint, read_json_array


@pytest.fixture
def tiny(spark):
    """Byte ranges of a few bytes, so that a small file is read as a large one is."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield of
    for k, v in before.items():
        spark.conf.set(k, v)


def items(seed, count):
    rng = random.Random(seed)
    texts = ["", "}", "{", "]", '"', "\\", '\\"', "}{", '"}', "a,b", "\n", "é}", "\\}", "[{"]
    text = lambda: "".join(rng.choices(texts, k=rng.randint(0, 4)))

    def value(depth):
        kind = rng.randint(0, 6 if depth < 3 else 3)
        if kind < 3:
            return text() if kind else rng.randint(-9, 10**20)
        return None if kind == 3 else [value(depth + 1) for _ in range(rng.randint(0, 3))] if kind == 4 else {text(): value(depth + 1) for _ in range(rng.randint(0, 3))}

    return [{f"k{i}{text()}": value(1) for i in range(rng.randint(0, 3))} for _ in range(count)]


@pytest.mark.parametrize(("seed", "size", "indent"), [(1, 30, None), (2, 90, 1), (3, 200, None), (4, 1 << 20, 2)])
def test_same_objects(spark, tmp_path, tiny, seed, size, indent):
    tiny(size)
    objects = items(seed, 40)
    path = tmp_path / "in.json"
    path.write_text(" " * (seed % 2) + json.dumps(objects, indent=indent, ensure_ascii=seed % 2 == 0) + "\n" * (seed % 3))
    rows = read_json_array(spark, str(path)).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(objects)))
    assert [json.loads(r.line) for r in rows] == objects


REFUSED = [
    ('[{"a":1} {"b":2}]', "INPUT_INVALID_JSON"), ('[{"a":1},]', "INPUT_INVALID_JSON"), ('[{"a":1},{"b":2}', "INPUT_INVALID_JSON"), ('[{"a":1}]]', "INPUT_INVALID_JSON"), ('[{"a":1}],[{"a":1}]', "INPUT_INVALID_JSON"),
    ('[{"a":1},{"b":}]', "INPUT_INVALID_JSON"), ('[{"a":[1}]]', "INPUT_INVALID_JSON"), ('[{"a":1}}', "INPUT_INVALID_JSON"), ('[{"a":"x}]', "INPUT_INVALID_JSON"), ('[{"a":"\\}"}]', "INPUT_INVALID_JSON"), ("", "INPUT_INVALID_JSON"),
    (" \n", "INPUT_INVALID_JSON"), ('[,{"a":1}]', "INPUT_INVALID_JSON"), ('[{"a":1}] x', "INPUT_INVALID_JSON"), ('{"a":1', "INPUT_INVALID_JSON"), ("[1", "INPUT_INVALID_JSON"), ("]", "INPUT_INVALID_JSON"),
    ('[1,{"a":1}]', "RECORD_NOT_OBJECT"), ('[{"a":1},"x{",{"b":2}]', "RECORD_NOT_OBJECT"), ('[{"a":1},null]', "RECORD_NOT_OBJECT"), ('[[{"a":1}]]', "RECORD_NOT_OBJECT"), ('[{"a":1},[{"b":2}],{"c":3}]', "RECORD_NOT_OBJECT"), ("[[]]", "RECORD_NOT_OBJECT"),
    ('{"a":{"b":1}}', "INPUT_NOT_ARRAY"), ('{"a":1}\n', "INPUT_NOT_ARRAY"), ('"text"', "INPUT_NOT_ARRAY"), ("null", "INPUT_NOT_ARRAY"), (" [ ]\n", "INPUT_EMPTY"),
]


@pytest.mark.parametrize(("text", "code"), REFUSED)
def test_refused(spark, tmp_path, text, code):
    path = tmp_path / "in.json"
    path.write_text(text)
    with pytest.raises(InputError) as e:
        read_json_array(spark, str(path))
    assert e.value.code == code


@pytest.mark.parametrize(("text", "code"), [REFUSED[i] for i in (1, 7, 18, 21)])
def test_refused_in_ranges(spark, tmp_path, tiny, text, code):
    tiny(40)
    test_refused(spark, tmp_path, text.replace(":", " " * 30 + ":" + " " * 30), code)


def test_bytes_that_are_no_text(spark, tmp_path):
    path = tmp_path / "in.json"
    path.write_bytes(b'[{"a":"\xff"}]')
    with pytest.raises(InputError) as e:
        read_json_array(spark, str(path))
    assert e.value.code == "INPUT_INVALID_JSON"


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_digests_of_files_read_in_ranges(spark, tmp_path, tiny, size):
    rng = random.Random(size)
    contents = [b"a\nb", b"a\nb\n", b"\n", b"\n\n\nx", b"\xef\xbb\xbfa\nb", b"\xef\xbb\xbfa\n", b"a\r\nb\r", rng.randbytes(900), bytes(rng.choices(b"\n\r\x00ab\xff", k=400))]
    for i, content in enumerate(contents):
        (tmp_path / f"f{i}").write_bytes(content)
    tiny(size)
    wanted = {f"f{i}": hashlib.sha256(c).hexdigest() for i, c in enumerate(contents)}
    for at_once in (0, 5, 1 << 28):
        assert {r.file: r.sha256 for r in input_fingerprint(spark, str(tmp_path), at_once).collect()} == wanted
