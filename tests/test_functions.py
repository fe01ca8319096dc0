import re

import pytest
from pyspark.sql import functions as F

from rollcall.errors import CodecError, NameGenerationError, PasswordError
from rollcall.functions import codec, generate
from rollcall.functions.generate import PasswordConfig
from rollcall.functions.ids import parsed_id
from rollcall.schema import PASSWORD_CONFIG, RECORD

ID = "a1d0c6e8-3f02-4327-9846-1063f4ac58a6"


def test_names(spark):
    for numbered, pattern in ((True, r"[a-z]+-[a-z]+-\d{4}"), (False, "[a-z]+-[a-z]+")):
        rows = [r["name"] for r in generate.names(spark, 50, numbered=numbered).collect()]
        assert len(rows) == 50 and all(re.fullmatch(pattern, x) for x in rows)
        assert re.fullmatch(pattern, generate.secure_name(numbered))
    assert generate.names(spark, 0).count() == 0
    with pytest.raises(NameGenerationError):
        generate.name_column(F.lit(1), adjectives=())


def test_draws_do_not_depend_on_partitions(spark):
    one = spark.range(100).repartition(1).select(generate.password_column(F.col("id")).alias("p"), "id")
    many = spark.range(100).repartition(4).select(generate.password_column(F.col("id")).alias("p"), "id")
    assert sorted(one.collect()) == sorted(many.collect())


@pytest.mark.parametrize("config", [PasswordConfig(), PasswordConfig(20, False, False, True, True, True, True, True), PasswordConfig(3, True, True, True, strict=True), PasswordConfig(1)])
def test_passwords(spark, config):
    rows = [r["password"] for r in generate.passwords(spark, 60, config).collect()] + generate.secure_passwords(20, config)
    classes = config.classes()
    for x in rows:
        assert len(x) == config.length and set(x) <= set("".join(classes))
        if config.strict:
            assert all(set(x) & set(c) for c in classes)
    if config.exclude:
        assert not set("".join(rows)) & set(generate.SIMILAR)


@pytest.mark.parametrize("config", [PasswordConfig(0), PasswordConfig(8, False, False), PasswordConfig(2, True, True, True, strict=True)])
def test_impossible_passwords(config):
    with pytest.raises(PasswordError):
        generate.secure_password(config)
    with pytest.raises(PasswordError):
        generate.password_column(F.lit(1), config)


def test_records(spark):
    rows = generate.records(spark, 30).collect()
    assert len({r["id"] for r in rows}) == 30 and all(parsed_id(r["id"]) == r["id"] for r in rows)


GOOD = f'{{"id": "{ID.upper()}", "name": "ä\\n", "hash": "x", "more": 1}}'
BAD = [
    "", "{", "[]", "null", '"x"', f'{{"id": "{ID}", "name": "n"}}', f'{{"id": "{ID}", "name": "n", "hash": 12}}', f'{{"id": "{ID}", "name": null, "hash": "h"}}',
    f'{{"id": "{ID}", "name": "a", "name": "b", "hash": "h"}}', '{"id": "12", "name": "n", "hash": "h"}',
]


def test_decode(spark):
    rows = codec.decoded(spark.createDataFrame([(k, b) for k, b in enumerate([GOOD, *BAD])], "k int, body string")).orderBy("k").collect()
    assert rows[0]["error"] is None and (rows[0]["id"], rows[0]["name"]) == (ID, "ä\n")
    assert all(r["error"] and r["id"] is None and r["hash"] is None for r in rows[1:])
    assert codec.decode_one(GOOD) == {"id": ID, "name": "ä\n", "hash": "x"}
    for b in BAD:
        with pytest.raises(CodecError):
            codec.decode_one(b)


CONFIG = '{"length": 20, "numbers": false, "lowercase": false, "uppercase": true, "symbols": true, "spaces": true, "exclude": true, "strict": true}'


def test_decode_config(spark):
    bad = [CONFIG.replace("20", x) for x in ("-1", '"20"', "2.5", "null", "true")] + [CONFIG.replace('"spaces": true, ', ""), CONFIG.replace("false", "0")]
    rows = codec.decoded(spark.createDataFrame([(k, b) for k, b in enumerate([CONFIG, *bad])], "k int, body string"), schema=PASSWORD_CONFIG, key=None).orderBy("k").collect()
    assert rows[0]["length"] == 20 and rows[0]["strict"] and not rows[0]["numbers"]
    assert all(r["error"] for r in rows[1:])
    for b in bad:
        with pytest.raises(CodecError):
            codec.decode_one(b, PASSWORD_CONFIG, None)


def test_encode(spark):
    rows = spark.createDataFrame([(ID, 'a "b"', "ü")], RECORD)
    body = rows.select(codec.encoded().alias("b")).first()["b"]
    assert body == codec.encode_one(rows.first().asDict()) and codec.decode_one(body)["name"] == 'a "b"'
    assert codec.encoded_list(rows.limit(0)).first()["body"] == "[]"


def test_secure_record_and_bounded_length():
    from rollcall.functions.ids import parsed_id

    one, two = generate.secure_records(2)
    assert set(one) == {"id", "name", "hash"} and one["id"] != two["id"] and parsed_id(one["id"]) == one["id"]
    assert len(generate.secure_record(PasswordConfig(20))["hash"]) == 20
    with pytest.raises(PasswordError):
        generate.secure_password(PasswordConfig(10**9))


def test_batch_and_single_decoding_agree_on_ids_and_numbers(spark):
    import json

    from rollcall.errors import CodecError
    from rollcall.functions import codec
    from rollcall.schema import PASSWORD_CONFIG

    ids = ["a1d0c6e8-3c5e-4b7a-9d2f-0123456789ab", "A1D0C6E8-3C5E-4B7A-9D2F-0123456789AB", "{a1d0c6e8-3c5e-4b7a-9d2f-0123456789ab}", "a1d0c6e83c5e4b7a9d2f0123456789ab", "urn:uuid:a1d0c6e8-3c5e-4b7a-9d2f-0123456789ab", "a1d0", "", "g" * 32,
           "0x" + "a" * 30, "a" * 31 + "_", "a_" * 16, " " + "a" * 31, "a" * 32 + "\n", "A1D0C6E8-3C5E-4B7A-9D2F-0123456789ab\n", "}" + "a" * 32, "a" * 33, "urn:a-a" + "b" * 30, "{{" + "B" * 32 + "}}", "\uff11" * 32]
    rows = spark.createDataFrame([(k, json.dumps({"id": x, "name": "n", "hash": "h"})) for k, x in enumerate(ids)], "k int, body string")
    got = {r["k"]: r["id"] for r in codec.decoded(rows).collect()}
    for k, x in enumerate(ids):
        try:
            want = codec.decode_one(json.dumps({"id": x, "name": "n", "hash": "h"}))["id"]
        except CodecError:
            want = None
        assert got[k] == want, x
    config = {"length": 8, "numbers": True, "lowercase": True, "uppercase": False, "symbols": False, "spaces": False, "exclude": False, "strict": False}
    for length in (8, -1, 2**63 - 1, 2**63, 2**70):
        body = json.dumps(config | {"length": length})
        batch = codec.decoded(spark.createDataFrame([(body,)], "body string"), "body", PASSWORD_CONFIG, None).first()["error"] is None
        try:
            codec.decode_one(body, PASSWORD_CONFIG, None)
            single = True
        except CodecError:
            single = False
        assert batch == single, length


def test_draws_are_fair():
    import numpy as np

    for n in (1, 3, 10, 24, 89):
        counts = np.bincount(generate.fair_draws(60_000, n), minlength=n)
        assert len(counts) == n and abs(counts - 60_000 / n).max() < 6 * (60_000 / n) ** 0.5 + 1
    assert len(generate.fair_draws(0, 5)) == 0
    from rollcall.functions.ids import random_ids

    ids = random_ids(500)
    assert len(set(ids)) == 500 and all(parsed_id(x) == x and x[14] == "4" and x[19] in "89ab" for x in ids)
    # obligatory characters stand anywhere
    config = PasswordConfig(5, True, True, True, strict=True)
    drawn = generate.fair_passwords(2000, config)
    assert all(any(c in x for c in own) for own in config.classes() for x in drawn)
    places = np.bincount([k for x in drawn for k, c in enumerate(x) if c.isupper()], minlength=5)
    assert places.min() > 0.8 * places.max()


def test_secure_records_for_the_rows_of_a_table(spark):
    rows = spark.range(1_000_000).selectExpr("id AS row", "id % 7 AS Name", "'x' AS `a.b`")
    out = generate.secure_for(rows, PasswordConfig(12))
    assert out.columns == ["row", "a.b", "id", "name", "hash"]
    got = out.agg(F.count("*"), F.countDistinct("id"), F.countDistinct("row"), F.min(F.length("hash")), F.max(F.length("hash")), F.countDistinct("hash")).first()
    assert tuple(got) == (1_000_000, 1_000_000, 1_000_000, 12, 12, 1_000_000)
    # what was drawn stays
    assert out.where("row < 5").orderBy("row").collect() == out.where("row < 5").orderBy("row").collect()
    assert generate.secure_for(spark.range(3).selectExpr("id")).count() == 3
    with pytest.raises(PasswordError):
        generate.secure_for(rows, PasswordConfig(0))


def test_pages(spark):
    rows = generate.records(spark, 60)
    pages = codec.encoded_pages(rows, digits=1).orderBy("page").collect()
    import json

    assert sum(p["n"] for p in pages) == 60 and all(len(json.loads(p["body"])) == p["n"] for p in pages)
    whole = [r for p in pages for r in json.loads(p["body"])]
    assert whole == json.loads(codec.encoded_list(rows).first()["body"])
