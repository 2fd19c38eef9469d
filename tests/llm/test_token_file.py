import zlib

import numpy as np
import public_tokenizers
from llm.cases import awkward, table
from tokenizers import Tokenizer

from stillwater.llm import token_file as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(map(tuple, T.token_round_trip(docs, PATH).collect()))
    assert got == expected(rows)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted((tuple(r) for r in T.token_round_trip(df, PATH).collect()), key=lambda r: r[1])
    same = lambda out: sorted((r[0] or -1, r[2], r[3]) for r in out)  # noqa: E731  equal ids stand in any order
    assert same(got) == same(expected(rows))
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    assert T.token_round_trip(df.limit(0), PATH).count() == 0


def test_shards_decode_by_document_and_stretch():
    rng = np.random.default_rng(3)
    docs = [np.append(rng.choice([5, 6, 7, 50_256], n), 0).astype("<u2") for n in (0, 1, 9, 5_000, 20_000)]
    raw = T.pack_shard([4, None, 6, 7, 8], [d.tobytes() for d in docs])
    shard = T.Shard(raw)
    assert shard.doc_ids == [4, None, 6, 7, 8] and len(shard.rules)
    assert len(raw) < sum(d.nbytes for d in docs)
    for k, d in enumerate(docs):
        assert (shard.document(k) == d).all()
        for low, high in ((0, len(d)), (len(d) // 3, len(d) // 2), (max(0, len(d) - 2), len(d))):
            assert (shard.stretch(k, low, high) == d[low:high]).all()


def test_pieces_encode_as_whole_texts():
    encoder = T.Encoder(PATH)
    for text in ("", " ", "  ", "a  b", "a \n b", "\n\n a", "x.\ny z", "don't I'll 3.5, (a)  ", "é ü.", "a b c", "a <|endoftext|> b", "tab\t end", "end \n"):
        assert encoder(text) == encoder.encode_whole(text), text


def test_unicode_space_beside_line_breaks():
    encoder = T.Encoder(PATH)
    for space in "\u00a0\u0085\u1680\u2003\u2009\u2028\u202f\u3000\t\r\x0b\x0c\x1c":
        for text in ("a\n{}\nb", "a\n{} b", "a\n{}", "a{}\nb", "a\n{}b", "{}\na", "a {}\n{} b", "a\n{}{}\n{}b c", "a b{}\n\n{}c"):
            text = text.replace("{}", space)
            assert encoder(text) == encoder.encode_whole(text), text


def test_random_white_space_and_marks():
    """As the library encodes whole texts, for texts of pieces that the cuts could get wrong."""
    import random

    import pyarrow as pa

    rng, encoder = random.Random(11), T.Encoder(PATH)
    parts = ["a", "b", "Zo", "é", "漢", "1", "42", ".", ",", "'s", "'", "(", "\n", "\n", "\n", " ", " ", "  ", " ", "\t", "\r", "\x85", " ",
             "　", "\x1c", "_", "²", "ª", "<", "|", "\x0b", "​", " ", "don't", "º", "½", "ß", "..!", "\0", "<|endoftext|>", "--------"]
    for _ in range(10):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
        whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(g, "<u2").tolist() for g in encoder.batch(pa.array(texts))] == [w.ids for w in whole]


def test_pieces_forgotten(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(T, "CACHE", 3)
    encoder = T.Encoder(PATH)
    for texts in (["a b c d.", None, "e f"], ["a x y z!", "b"], ["d. c", ""], ["d. c q"]):
        assert encoder.batch(pa.array(texts, pa.string())) == [encoder.encode_whole(t or "") for t in texts]


def test_re_pair_until_no_pair_is_frequent():
    from collections import Counter

    rng = np.random.default_rng(5)
    docs = [np.append(rng.choice(60, 700, p=np.arange(60, 0, -1) / 1830), 0) for _ in range(40)]
    ids = np.concatenate(docs).astype("<u2")
    starts = np.cumsum([0] + [len(d) for d in docs[:-1]])
    rules, sequence, places = T.re_pair(ids, starts)
    inside = np.ones(len(sequence), bool)
    inside[places] = False
    left = Counter(zip(sequence[:-1].tolist(), sequence[1:].tolist()))
    left = Counter(p for p, ok in zip(zip(sequence[:-1].tolist(), sequence[1:].tolist()), inside[1:]) if ok)
    assert len(rules) and max(left.values()) < T.LEAST_COUNT


def test_too_large_a_vocabulary(monkeypatch):
    import pytest

    monkeypatch.setattr(T, "FIRST_RULE", 50_000)
    with pytest.raises(ValueError):
        T.Encoder(PATH)


def test_one_document_from_a_file(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    docs = [np.append(rng.choice([5, 6, 7], n), 0).astype("<u2") for n in (0, 300, 9, 5_000)]
    (tmp_path / "s").write_bytes(T.pack_shard([1, 2, 3, 4], [d.tobytes() for d in docs]))
    with pa.OSFile(str(tmp_path / "s")) as source:
        shard = T.Shard(source)
        assert (shard.document(1) == docs[1]).all() and (shard.stretch(3, 70, 90) == docs[3][70:90]).all()
        assert all((a == b).all() for a, b in zip(shard.documents(7), docs))
