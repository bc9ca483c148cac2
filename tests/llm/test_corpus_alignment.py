"""Cross-tokenizer alignment against the libraries on whole texts, and brute-force counts."""

import collections
import hashlib
import json
import random

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from crateflow.llm import alignment, queries
from crateflow.llm.bpe import _byte_of_char

ODD = ["", " ", "  ", "a  b", "a \n b", "x  y", "x　  y z", "it's  they'll 're", "▁", "a▁b c", "<s> </s> <unk>", "<0x41> a",
       "<|endoftext|> end", "\x00\x01 \x1f y", "tab\t x\t\ty", "日本語 テキスト", "é é", "😀 😀😀", "ﬁ ½ Ⅷ", "a\x85 b \x1c c", "\r\n x",
       " lead", "trail ", "1 22 333 4444", "ÀÉ naïve façade"]


def ends(parts):
    out, at = {}, 0
    for i, part in enumerate(parts):
        at += len(part)
        out[at] = i
    return out


def brute(texts, path_a=None, path_b=None):
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    chars = _byte_of_char()
    rows, counts = [], collections.Counter()
    for text in texts:
        ids_a = ids_b = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
            parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
                ids_a = ids_b = []
        if not ids_a:
            rows.append((0, 0, [], []))
            continue
        ends_a, ends_b = ends(parts_a), ends(parts_b)
        cut_a = cut_b = 0
        groups, links = [], []
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(",".join(map(str, ids_a[cut_a:ends_a[end] + 1])) + "|" + ",".join(map(str, ids_b[cut_b:ends_b[end] + 1])))
            cut_a, cut_b = ends_a[end] + 1, ends_b[end] + 1
            links.append((ids_a[cut_a - 1], ids_b[cut_b - 1]))
        counts.update(links)
        rows.append((len(ids_a), len(ids_b), groups, links))
    highest = collections.Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return [(na, nb, len(g), len(x), sum(counts[p] == highest[p[1]] for p in x), sum(counts[p] for p in x), ";".join(g) or None)
            for na, nb, g, x in rows]


def test_alignment_matches_whole_texts(spark):
    rnd = random.Random(3)
    signs = "ab é 　  \n\t'sd1½日▁<>😀"
    texts = ODD + [None] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    texts += ["the same text", "the same text", "word " * 30_000, "nospace" * 3000]
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_a string, slice int").repartition(3)
    got = alignment.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), slice_bytes=1000).collect()
    want = collections.Counter((r[0], *w) for r, w in zip(rows, brute(texts)))
    assert collections.Counter(tuple(r) for r in got) == want


def test_alignment_of_invalid_bytes_and_empty_table(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text UNION ALL SELECT 2L, 'ab'")
    got = {r.doc_id: r for r in alignment.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).collect()}
    assert (got[1].n_a, got[1].groups) == (0, None) and got[2].n_groups > 0
    assert alignment.align(docs.limit(0), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")).count() == 0


def test_op12_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
            for d, w in zip(docs, brute([d.text for d in docs]))}
    got = queries.op12_cross_tokenizer_alignment(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_ids_that_do_not_follow_the_merges_are_refused():
    with open(P.path("byte_bpe_50k.json")) as f:
        spec = json.load(f)
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        pieces = f.read()
    with pytest.raises(ValueError):
        alignment.TokenizerPair(json.dumps(spec).encode(), pieces)


def test_units_aligned_in_blocks_give_the_same():
    with open(P.path("byte_bpe_50k.json"), "rb") as a, open(P.path("piece_bpe_32k.model"), "rb") as b:
        pair = alignment.TokenizerPair(a.read(), b.read())
    rnd = random.Random(7)
    units = sorted({u for text in ODD for u in alignment.text_units(text.encode())} | {"".join(rnd.choices("abcdeé\U0001f600", k=rnd.randint(1, 9))) for _ in range(300)})
    whole, parts = pair.align(units, block=1 << 30), pair.align(units, block=16)
    for name in ("spelled", "n_a", "n_b", "n_links", "links"):
        assert getattr(whole, name).tolist() == getattr(parts, name).tolist()
    assert whole.texts == parts.texts and len(parts.texts) == len(units)
    assert pair.align([]).texts == [] and len(pair.align([]).links) == 0


def test_what_a_slice_sends_is_packed():
    import numpy as np
    import pyarrow as pa

    with open(P.path("byte_bpe_50k.json"), "rb") as a, open(P.path("piece_bpe_32k.model"), "rb") as b:
        pair = alignment.TokenizerPair(a.read(), b.read())
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(2000)) for _ in range(5)]
    row = alignment._slice(pair, 0, pa.RecordBatch.from_pydict({"doc_id": [*range(5)], "text": texts})).to_pylist()[0]
    found = pair.align(list(dict.fromkeys(u for t in texts for u in alignment.text_units(t.encode()))))
    assert alignment.unpack_lines(row["unit_groups"]) == found.texts and alignment.unpack(row["unit_links"]).tolist() == found.n_links.tolist()
    assert len(row["unit_groups"]) < sum(map(len, found.texts)) / 2 and len(row["unit_links"]) < len(found.n_links)
    assert alignment.unpack_lines(alignment.pack_lines([])) == [""] and not len(alignment.unpack(alignment.pack(np.zeros(0, np.int64))))
