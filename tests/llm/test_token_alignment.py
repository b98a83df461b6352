"""Cross-tokenizer alignment against whole texts aligned token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from whyframe.llm import token_alignment as ta  # noqa: E402

from .helpers import prose  # noqa: E402

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a", " ", "  ", "\n", " lead", "trail ", "a  b", "a\tb c", "a\n\nb", "a\n b", "a \n b\n", "x y　z", "don't we'll STOP... now!!", "<|endoftext|> a <|endoftext|>b", "<s> </s><unk>x <s>", "<0x41> b", "a▁b c", "▁", "Straße über İstanbul ΣΑΣ.", "é é. q", "日本 語。\n日本", "a\n.b c\n\tz", "À.\nß, ÿ", "\x00 b", "a\r\nb", "a\x1c b", "a᠎ b", "a​ b", "🙂 🙂🙂 x", "1234567890 12 345", "é ﬁ Ⅷ ½"]


def whole(text):
    """(ids of A, ids of B, ends of A, ends of B) from the libraries, or None."""
    t = tokenizers.Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {}
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = 256
    for byte in range(256):
        back[chr(byte if byte in kept else extra)] = bytes([byte])
        extra += byte not in kept
    while True:
        text = yield _one(text, t, sp, back)


def _one(text, t, sp, back):
    if not text:
        return None
    a = t.encode(" " + text, add_special_tokens=False)
    bytes_a = [b"".join(back[c] for c in t.id_to_token(i)) for i in a.ids]
    ids_b = sp.encode(text)
    bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    return a.ids, ids_b, np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()


def brute(rows, links):
    """Rows of (id, text) by plain loops over all tokens."""
    tool, found, counts = whole(""), [], Counter()
    next(tool)
    for i, text in rows:
        got = tool.send(text)
        if got is None:
            found.append((i, 0, 0, 0, [], ""))
            continue
        a, b, ea, eb = got
        groups, pairs, x, y = [], [], 0, 0
        for end in sorted(set(ea) & set(eb)):
            p, q = ea.index(end, x) + 1, eb.index(end, y) + 1
            groups.append((list(range(x, p)), list(range(y, q))))
            x, y = p, q
        starts_a, starts_b = [0, *ea], [0, *eb]
        for ga, gb in groups:
            for m in ga:
                for n in gb:
                    if links == "group" or (links == "ends" and ea[m] == eb[n]) or (links == "overlap" and max(starts_a[m], starts_b[n]) < min(ea[m], eb[n])):
                        pairs.append((a[m], b[n]))
        counts.update(pairs)
        text_of = ";".join(",".join(str(a[m]) for m in ga) + "|" + ",".join(str(b[n]) for n in gb) for ga, gb in groups)
        found.append((i, len(a), len(b), len(groups), pairs, hashlib.sha256(text_of.encode()).hexdigest()))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((i, na, nb, ng, len(p), sum(counts[x] == best[x[1]] for x in p), sum(counts[x] for x in p), h) for i, na, nb, ng, p, h in found), key=str)


def documents(spark):
    rng = random.Random(11)
    words = ["the", "of", "Haus", "über", "naïve", "foo_bar", "x=1;", "1,234.56", "日本", "it's", "antidisestablishment", "🙂", "--", "zqxv"]
    rows = [(k, t) for k, t in enumerate(ODD)] + [(100 + k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", " \n", "", ", "]) for _ in range(rng.randrange(1, 120)))) for k in range(60)]
    rows += [(300, None), (301, ""), (None, "lost and found"), (302, "twin text"), (302, "twin text"), (303, " ".join(prose(rng, 20_000, 300)))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS links", "3 AS row", "4 AS id", "5 AS code").repartition(4)


@pytest.mark.parametrize("links", ta.LINKS)
def test_as_whole_texts(spark, links):
    rows, df = documents(spark)
    got = ta.cross_tokenizer_alignment(df, A, B, links, block=3000)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, links)


def test_a_full_table_of_pieces_starts_anew(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["red", "green", "blue", "x=1;", "naïve", "\n"]) + str(rng.randrange(9)) for _ in range(rng.randrange(30))) for _ in range(40)]
    tool = ta.Aligner(A, B, "group")
    expected = [tool.document(t) for t in texts]
    assert len(tool.known) > 14
    monkeypatch.setattr(ta, "ROOM", 7)
    tool = ta.Aligner(A, B, "group")
    assert [tool.document(t) for t in texts] == expected


def test_counts_of_pairs(spark):
    rows, df = documents(spark)
    aligned = ta.align_documents(df, A, B)
    got = {(r.a_id, r.b_id): (r["count"], r.best) for r in ta.pair_counts(ta.block_pairs(aligned)).collect()}
    assert sum(n for n, _ in got.values()) == sum(r[4] for r in brute(rows, "ends"))
    for (_, b), (n, best) in got.items():
        assert best == (n == max(m for (_, c), (m, _) in got.items() if c == b))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ta.cross_tokenizer_alignment(empty, A, B).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ta.cross_tokenizer_alignment(nothing, A, B).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    with pytest.raises(ValueError):
        ta.align_documents(nothing, A, B, "all")


def test_elementary_intervals():
    a, b, closes = ta.elementary(np.array([2, 3, 5, 9]), np.array([1, 3, 9]))
    assert a.tolist() == [0, 0, 1, 2, 3] and b.tolist() == [0, 1, 1, 2, 2] and closes.tolist() == [False, False, True, False, True]
    left, right = ta.group_products(a, b, closes)
    assert list(zip(left.tolist(), right.tolist())) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (3, 2)]
