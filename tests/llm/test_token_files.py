import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from harrier.llm import token_files
from harrier.llm.shared import Scratch
from harrier.llm.token_files import Encoder, Part, op7_token_files, read_tokens, write_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(VOCABULARY)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


def brute(rows):
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        x = ids(t)
        out.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    return out


@pytest.mark.parametrize("text", ["", " ", "a  b", " a b ", "a \n b\n\n c", "it's  <|endoftext|> x", "x <|endoftext|>", "Straße 12,5 € 　 日本 !!", "a\0 b \0", "a\t b \tc", "'s 's 've", "\n a", "a \n", "  a  b"])
def test_pieces_are_the_whole(text):
    e = Encoder(VOCABULARY)
    for _ in range(2):
        assert e.encode([text])[0].tolist() == ids(text)[:-1]


def test_many_texts_at_once(monkeypatch):
    """Pieces that many texts share, punctuation behind words, texts longer than a chunk, memory that forgets."""
    rnd = random.Random(1)
    word = lambda: rnd.choice(["it's", "Straße", "12,5", "e.g.", "wow!!!", "日本", "\n", "a\tb", "x\n\n", "''", ".", "?!", "naïve,", "C3PO.", "²,", "e\u0301.", "<|endoftext|>" if rnd.random() < 0.01 else "z"] + ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6))) + rnd.choice(["", ".", ",", ";!"])])
    texts = [(" " if rnd.random() < 0.98 else "  ").join(word() for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["", " ", "x" * 3000, "word " * 2000]
    for chunk, remembered in ((1 << 22, 500_000), (400, 300), (1 << 22, 40)):
        monkeypatch.setattr(token_files, "CHUNK", chunk)
        monkeypatch.setattr(token_files, "REMEMBERED", remembered)
        e = Encoder(VOCABULARY)
        for part in (texts[:150], texts[150:], texts):
            found, counts = e.encode(part)
            ends = np.cumsum(counts)
            assert [found[b - n : b].tolist() for n, b in zip(counts, ends)] == [ids(t)[:-1] for t in part]


def test_all_white_space():
    """Blanks, every other white space, contractions and special tokens in all neighbourhoods."""
    white = [chr(c) for c in [*range(9, 14), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]]
    rnd = random.Random(7)
    alike = ["end \xa0 \xa0", "a\xa0 \xa0 \xa0", "\xa0 \xa0", " \xa0 ", "x\n \ny", "\u3000 \u3000z"]
    texts = alike + ["".join(rnd.choice([" ", " ", " ", rnd.choice(white), "\xa0", "a", "end", "'s", "12", ".", "é", "<|endoftext|>" if rnd.random() < 0.02 else "b"]) for _ in range(rnd.randint(1, 14))) for _ in range(20_000)]
    found, counts = Encoder(VOCABULARY).encode(texts)
    ends = np.cumsum(counts)
    assert [found[b - n : b].tolist() for n, b in zip(counts, ends)] == [ids(t)[:-1] for t in texts]


def test_a_file_that_is_there_already(tmp_path):
    disk, root = token_files._open(str(tmp_path))
    for data in (b"same", b"same", b"other"):
        (tmp_path / "mine").write_bytes(data)
        token_files._put(disk, f"{root}/mine", f"{root}/part")
        assert (tmp_path / "part").read_bytes() == data and not (tmp_path / "mine").exists()


def test_awkward(awkward, spark):
    path = Scratch(spark, "t").path
    manifest = write_tokens(spark, awkward, path, VOCABULARY)
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = brute(rows)
    assert sorted((tuple(r)[:4] for r in read_tokens(spark, path).collect()), key=lambda r: r[1]) == want
    whole = np.concatenate([Part(path, m.part, m.width).tokens for m in sorted(manifest.collect(), key=lambda m: m.part)])
    assert PLAIN.decode(whole[want[0][2] :][: ids(rows[0][1]).__len__() - 1].tolist()) == rows[0][1]


def test_empty(nothing, spark):
    path = Scratch(spark, "t").path
    write_tokens(spark, nothing, path, VOCABULARY)
    assert read_tokens(spark, path).count() == 0


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:4] for r in op7_token_files(spark, sf).collect()), key=lambda r: r[1]) == brute(rows)
