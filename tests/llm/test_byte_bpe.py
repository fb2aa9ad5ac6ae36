import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from harrier.llm import byte_bpe
from harrier.llm.byte_bpe import Decoder, Encoder, Transducer, decode_documents, encode_documents, op12_byte_bpe, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encoded(encoder, texts):
    ids, counts = encoder.encode(texts)
    ends = np.cumsum(counts)
    return [ids[b - n : b].tolist() for n, b in zip(counts, ends)]


def brute(rows):
    out = []
    for i, t in rows:
        ids = PLAIN.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def random_texts(n, seed):
    rnd = random.Random(seed)
    white = [" ", " ", " ", "\n", "\t", "\xa0", "　", "\x85", "\x1c"]
    other = lambda: chr(rnd.choice([rnd.randrange(0x20, 0x7F), rnd.randrange(0x80, 0x800), rnd.randrange(0x3000, 0x9000), rnd.randrange(0x10000, 0x1FFFF)]))
    for _ in range(n):
        k = rnd.randint(0, 40)
        kind = rnd.random()
        if kind < 0.4:
            yield "".join(rnd.choice("abeintrshéß") for _ in range(k))
        elif kind < 0.7:
            yield "".join(rnd.choice(white) if rnd.random() < 0.4 else rnd.choice(["a", "the", "'s", "'ll", "12", ".", "!?", "日本"]) for _ in range(k))
        else:
            yield "".join(other() for _ in range(k))


def test_random_texts_as_the_library_does():
    texts = list(random_texts(6000, 2))
    want = [PLAIN.encode_ordinary(t) for t in texts]
    for cuts in (True, False):
        assert encoded(Encoder(RANKS, public_tokenizers.PATTERN, cuts), texts) == want


def test_every_kind_of_character():
    texts = ["a" + chr(c) + "1 " + chr(c) * 2 + " .x" for c in [*range(0xD800), *range(0xE000, 0x12000)]]
    assert encoded(Encoder(RANKS, public_tokenizers.PATTERN, True), texts) == [PLAIN.encode_ordinary(t) for t in texts]


def test_few_states_and_pieces_without_end(monkeypatch):
    """States are forgotten and made anew, also in the middle of a piece; memories turn over; texts are cut."""
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdehinorst") for _ in range(200_000))
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    monkeypatch.setattr(byte_bpe.token_files, "CHUNK", 300)
    e = Encoder(RANKS, public_tokenizers.PATTERN, True)
    e.transducer = Transducer(RANKS, 40)
    texts = [long, " " * 5000, "é" * 3000, *random_texts(500, 3), " ".join(random_texts(400, 5))]
    for _ in range(2):
        assert encoded(e, texts) == [PLAIN.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("size", [256, 300, 700, 5000])
def test_smaller_vocabularies_with_tokens_that_do_not_merge(size):
    """The first ranks of the vocabulary, and tokens that no merges make: only a piece that is one of them has its id."""
    rnd = random.Random(size)
    ranks = {t: i for t, i in RANKS.items() if i < size}
    for t in (b"qzxq", b"zzzqzz", "日本語で".encode(), b" qx\n"):
        ranks[t] = len(ranks)
    plain = tiktoken.Encoding("few", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    t = Transducer(ranks, 500).check()
    for _ in range(2000):
        piece = "".join(rnd.choice(["e", "t", "h", "in", "er", " ", "qzxq", "z", "日本", "é"]) for _ in range(rnd.randint(1, 30)))
        assert t.encode(piece.encode()) == plain.encode_ordinary(piece), piece
    assert [t.encode(x) for x in ranks] == [[i] for i in ranks.values()]


def test_ranks_out_of_order():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257}
    with pytest.raises(ValueError):
        Transducer(ranks).check()


def test_a_byte_without_token():
    with pytest.raises(ValueError):
        Transducer({b"a": 0})


def test_streams_of_ids():
    """However ids are cut into stretches, characters come whole and all bytes come."""
    rnd, d = random.Random(6), Decoder(RANKS)
    for text in [*random_texts(300, 8), "日本語と😀é" * 50]:
        ids, out = PLAIN.encode_ordinary(text), []
        at = 0
        while at < len(ids):
            step = rnd.randint(0, 4)
            out.append(d.push(ids[at : at + step]).decode("utf-8"))
            at += step
            assert len(d.held) <= 3
        assert "".join(out) == text and d.finish() == b""


def test_ids_that_are_not_text():
    """Random ids: the bytes are kept, only an open character waits, and what waits can still become one."""
    rnd, d = random.Random(9), Decoder(RANKS)
    low = [RANKS[bytes([b])] for b in range(256)]
    for _ in range(2000):
        ids = [rnd.choice(low) if rnd.random() < 0.8 else rnd.randrange(len(RANKS)) for _ in range(rnd.randint(0, 12))]
        got = b""
        for i in ids:
            got += d.push([i])
            whole = got + d.held
            lead = next((k for k in (1, 2, 3) if whole[-k:][:1] >= b"\xc0"), 0)
            can = [tail for tail in (b"\x80", b"\x80\x80", b"\x80\x80\x80", b"\xbf", b"\xbf\xbf", b"\xbf\xbf\xbf", b"\x90\x80\x80", b"\x90\x80", b"\xa0\x80") if lead and _is_one(whole[-lead:] + tail)]
            assert d.held == (whole[-lead:] if can else b"")
        assert got + d.finish() == b"".join(PLAIN.decode_single_token_bytes(i) for i in ids)


def _is_one(data):
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_awkward(awkward, nothing, spark):
    got = decode_documents(encode_documents(awkward, PATH, public_tokenizers.PATTERN, cuts=True), PATH).selectExpr("doc_id", "ids", "cast(data AS string) AS text")
    want = [(r.doc_id, PLAIN.encode_ordinary(r.text or ""), r.text or "") for r in awkward.collect()]
    assert sorted(((r.doc_id, r.ids, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert encode_documents(nothing, PATH, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([(1, None, "x"), (None, [], "y"), (2, [RANKS[b"\xe6"]], "z")], "doc_id long, ids array<int>, data string")
    assert {(r.doc_id, bytes(r.data)) for r in decode_documents(ids, PATH).collect()} == {(1, b""), (None, b""), (2, b"\xe6")}


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert results(op12_byte_bpe(spark, sf)) == brute(rows)
