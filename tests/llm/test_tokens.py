import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from rollcall.llm import packed_ids, suffix_pieces, units, whole_tokens
from rollcall.llm import textbytes as tb
from rollcall.llm.runtime import scratch

from .data import SCHEMA, frame, rows, with_clashes

BITS = [
    "a", "B", "don't", "'s", "'S", " ", "  ", "   ", "\n", "\t", "é", "É", "é", "É", "ñ", "×", "÷", "İ", "“", "”", ",", ".", "(", ")", "1", "23", "漢字", "😀", "<", "|", ">",
    "<|endoftext|>", "<|startoftext|>", "≠", "≠", "\x1c", "\x85", "\x0b", "_", "word", "The", "ß", "K", "ſ", "''", "'re", "ﬁ", "​", "-", "—", "<s>", "</s>", "<0x41>", "▁", "▁▁", "the", "ing", "tion", "\x00", " " * 17, "aaaa", " ", "　",
]


def odd_texts(n=1500):
    rng = random.Random(5)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(25))) for _ in range(n)] + [r[1] or "" for r in rows()]


def parts(texts, size=20_000):
    return list(tb.slices(pa.array(texts), size))


def test_counts_are_the_librarys():
    texts = odd_texts()
    counter = whole_tokens.Counter(whole_tokens.TOKENIZER)
    got = np.concatenate([counter.count(d, o) for _, _, d, o in parts(texts)])
    want = counter.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert got.tolist() == [len(x.ids) for x in want]


def test_proven_strings_count_one():
    tokenizer = whole_tokens.load_tokenizer(whole_tokens.TOKENIZER)
    proven = whole_tokens.proven_strings(tokenizer)
    assert len(proven) > 45_000 and proven[" the"] == tokenizer.token_to_id("Ġthe") and "<|endoftext|>" not in proven


def test_a_full_memory_forgets_and_counts_on():
    texts = odd_texts()
    counter = whole_tokens.Counter(whole_tokens.TOKENIZER)
    want = np.concatenate([counter.count(d, o) for _, _, d, o in parts(texts)])
    counter.memory.limit = len(counter.memory._given[0]) + 300
    got = np.concatenate([counter.count(d, o) for _, _, d, o in parts(texts, 2000)])
    assert (got == want).all()


def test_a_full_memory_keeps_what_recurs():
    asked = []

    def encode(names):
        asked.extend(names)
        return np.array([len(x) % 3 for x in names]), np.array([x[0] for x in names for _ in range(len(x) % 3)], dtype=np.int32)

    def look_up(words):
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(x) for x in raw])
        data, starts = np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(x) for x in raw]
        at, lens, _ = memory.look_up(data, starts, ends, tb.run_hashes(data, starts, ends))
        assert lens.tolist() == [1 if w == "given" else len(w) % 3 for w in words]
        assert memory.gather(at, lens).tolist() == [7 if w == "given" else ord(w[0]) for w in words for _ in range(1 if w == "given" else len(w) % 3)]

    memory = units.UnitMemory(encode, 100, (whole_tokens._hashes(["given"]), np.array([7], dtype=np.int32)))
    often = [chr(97 + k) * (k + 1) for k in range(20)]
    for k in range(50):
        look_up(["given", *often, *[f"{j}rare{k}" for j in range(10)]])
        assert len(memory.keys) <= 100 and len(memory.keys) == len(memory.at) == len(memory.lens) == len(memory.calls)
    assert len(asked) == 20 + 50 * 10 and b"given" not in asked
    look_up([f"{j}more" for j in range(300)])
    look_up(["given", *often])


def test_count_query(spark):
    got = whole_tokens.token_counts(with_clashes(frame(spark), "n_tokens")).collect()
    tokenizer = whole_tokens.load_tokenizer(whole_tokens.TOKENIZER)
    want = sorted(((d, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in rows()), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert whole_tokens.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_are_the_librarys():
    texts = odd_texts()
    encoder = packed_ids.Encoder(packed_ids.TOKENIZER)
    lens, ids = (np.concatenate(x) for x in zip(*(encoder.encode(d, o, 1) for _, _, d, o in parts(texts))))
    want = [x.ids + [1] for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert lens.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("name", [packed_ids.TOKENIZER, whole_tokens.TOKENIZER])
def test_plain_words_are_the_librarys(name):
    """Words that pass by the normalizer and the pre-tokenizer, and the like of them that may not."""
    tokenizer = whole_tokens.load_tokenizer(name)
    pattern, _ = units.plain_words(tokenizer)
    rng = random.Random(3)
    letters = "etaoinshrdluETAOINéèßñçÿÉÖªµº×÷'1 ́ıſ漢"
    words = ["the", " the", "x" * 5000, " " + "é" * 3000]
    for some in (letters[:12], letters[:24], letters):
        words += [rng.choice(["", " "]) + "".join(rng.choices(some, k=rng.randrange(1, 30))) for _ in range(7000)]
    lens, ids = units.encoder(tokenizer)([w.encode() for w in words])
    want = [x.ids for x in tokenizer.encode_batch(words, add_special_tokens=False)]
    assert lens.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert 2000 < sum(pattern.fullmatch(w) is not None for w in words) < 18_000
    assert (pattern.fullmatch(" the") is not None) == (name == whole_tokens.TOKENIZER) and (pattern.fullmatch("The") is not None) == (name == whole_tokens.TOKENIZER)


def test_tokenizers_without_plain_words():
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    tokenizer = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2}, [("a", "b")]))
    assert units.encoder(tokenizer)([b"ab", b"ba"])[1].tolist() == [2, 1, 0]
    tokenizer.pre_tokenizer = pre_tokenizers.Split("b", "isolated")
    assert units.plain_words(tokenizer) is None and units.encoder(tokenizer)([b"ab"])[1].tolist() == [0, 1]
    tokenizer.normalizer = normalizers.Prepend("_")
    assert units.plain_words(tokenizer) is None


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 4000])
def test_words_round_trip(n):
    rng = np.random.default_rng(n)
    for values in (np.zeros(n), rng.integers(0, 2, n), rng.integers(0, 50_000, n), rng.integers(0, 1 << 62, n)):
        values = values.astype(np.uint64)
        words, offsets = packed_ids.pack(values)
        assert (packed_ids.unpack(words, offsets, n) == values).all()
    values = np.array([(1 << 64) - 1 if x else 3 for x in rng.random(n) < 0.4], dtype=np.uint64)
    words, offsets = packed_ids.pack(values)
    assert (packed_ids.unpack(words, offsets, n) == values).all()


def test_files(spark):
    folder = scratch(spark, "test-packed")
    made = packed_ids.write_files(with_clashes(frame(spark), "ids", "FILE", "tie"), folder, file_ids=700, task_bytes=4000).orderBy("file").collect()
    assert len(made) > 3
    got = packed_ids.read_files(spark, folder).orderBy("file", "nth").collect()
    tokenizer = whole_tokens.load_tokenizer(packed_ids.TOKENIZER)
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    # rows of one id stand in the order of a hash
    want = [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in order]
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == sorted(want, key=str)
    assert sum(x["n_ids"] for x in made) == sum(len(r["ids"]) for r in got)


def test_packed_query(spark, tmp_path):
    frame(spark, [r for r in rows() if r[0] is not None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = packed_ids.query(spark, str(tmp_path)).orderBy("start").collect()
    tokenizer = whole_tokens.load_tokenizer(packed_ids.TOKENIZER)
    start = 0
    for r, (d, t, *_) in zip(got, sorted((r for r in rows() if r[0] is not None), key=lambda r: (r[0], (r[1] or "")))):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert tuple(r) == (d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert packed_ids.query(spark, f"{tmp_path}/none").count() == 0


def test_pieces_are_the_librarys():
    texts = odd_texts()
    model = suffix_pieces.PieceModel(suffix_pieces.MODEL)
    for _, _, d, o in parts(texts):
        lens, ids = model.encode(d, o)
        raw, off = model.decode(lens, ids)
        for k, part in enumerate(np.split(ids, np.cumsum(lens)[:-1])):
            text = d[o[k] : o[k + 1]].tobytes().decode()
            want = model.library.encode(text)
            assert part.tolist() == want, text
            assert raw[off[k] : off[k + 1]].tobytes().decode(errors="replace") == model.library.decode(want)
            if "▁" not in text:
                assert raw[off[k] : off[k + 1]].tobytes().decode() == text


def test_long_texts_without_spaces(spark):
    """Stretches that no piece lies across are relaxed side by side; the ids stay the library's."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("漢字本日語文中国人民") for _ in range(60_000)), "".join(rng.choice("abcdefghij0123456789+/") for _ in range(20_000)), "x" * 4000]
    model = suffix_pieces.piece_model()
    lens, ids = model.encode(*parts(texts, 1 << 30)[0][2:])
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [model.library.encode(t) for t in texts]


def test_columns_that_clash(spark):
    docs = with_clashes(frame(spark), "IDS", "a.b", "Decoded", "__row")
    encoded = suffix_pieces.encode_documents(docs)
    assert encoded.columns == [c for c in docs.columns if c not in ("text", "IDS")] + ["ids"]
    decoded = suffix_pieces.decode_documents(encoded)
    assert decoded.columns == [c for c in encoded.columns if c != "Decoded"] + ["decoded"] and decoded.count() == len(rows())
    assert suffix_pieces.decoded_digest(encoded).count() == len(rows())
    assert suffix_pieces.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pieces_query(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_pieces.query(spark, str(tmp_path)).collect()
    library = suffix_pieces.piece_model().library
    want = sorted(((d, len(library.encode(t or "")), zlib.crc32(np.array(library.encode(t or ""), dtype="<i4").tobytes())) for d, t, *_ in rows()), key=str)
    assert sorted(((r["doc_id"], r["n_ids"], r["ids_crc32"]) for r in got), key=str) == want
    assert all(r["round_trip"] for r in got)
    encoded = spark.createDataFrame([(1, None), (2, []), (3, [1, 2])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in suffix_pieces.decode_documents(encoded).orderBy("doc_id").collect()] == ["", "", ""]
