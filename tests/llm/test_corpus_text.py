"""BPE, token counts, language ID, line dedup and licences against plain versions."""

import pathlib
import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from crateflow.llm import bpe, langid, licenses, line_dedup, token_counts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a", "a  b\n\n c   ", "<|endoftext|>x <|endoftext|> y  <|endoftext|>", "it's we'll '' 'RE 's", "日本語 テキスト123 ١٢٣ ²½",
       "a" * 5000, "  x　 y", "é̀ " * 3, "😀👍🏽" * 10, " \t\r\n x\x1c y", "ab1c2d3" * 100, "x" * 70000 + " y", "\n \n", "a  b　 c"]


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return bpe.ByteBpe(f.read())


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


def _texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def test_bpe_equals_the_library(spark, model, library):
    rnd = random.Random(1)
    made = ["".join(rnd.choice("abcdefghiestr nATION'sé1 \n日.,-|") for _ in range(rnd.randint(1, 80))) for _ in range(800)]
    for text in _texts(spark) + ODD + made:
        want = library.encode(text, add_special_tokens=False).ids
        assert model.encode(text).tolist() == want
        assert model.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_batches_windows_and_generations(model, library):
    small = bpe.ByteBpe(open(PATH, "rb").read())
    small.CACHED_UNITS = 50
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc de.\n<|endoftext|>é") for _ in range(rnd.randint(0, 400))) for _ in range(60)] + ODD + [None]
    for t in range(3):
        flat, counts = small.encode_texts(pa.array(texts))
        want = [library.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for w in want for i in w]
    data = np.frombuffer(" ".join(["wörd one, two."] * 500).encode(), np.uint8)
    ids, n = model.encode_buffer(data, np.array([0, len(data)]), window=64)
    assert ids.tolist() == library.encode(data.tobytes().decode(), add_special_tokens=False).ids and n.sum() == len(ids)


def test_bpe_checks_pairs_and_merges_only_what_fails(model):
    a, b = np.random.default_rng(0).integers(0, 50256, (2, 3000))
    want = [model.merge_long(model.token[x] + model.token[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert model.compatible(a, b).tolist() == want
    assert 0 < model.merged_exactly < model.checked


def test_bpe_frame_keeps_columns_and_handles_nulls(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", "z")],
                                 "doc_id bigint, text string, decoded string")
    out = bpe.encode_decode(docs, PATH).collect()
    assert len(out) == 4 and {(r.text, r.decoded, len(r.token_ids)) for r in out} == {(None, "", 0), ("", "", 0), ("a b", "a b", 2)}
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_token_counts_after_random_edits(spark, model):
    rnd = random.Random(3)
    rows = []
    for n, text in enumerate(_texts(spark)[:80] + ODD[:12] + [None]):
        edits, size = [], len(text or "")
        for _ in range(rnd.randint(0, 6)):
            a = rnd.randint(-2, size + 2)
            edits.append((a, a + rnd.choice([0, 0, 1, 5, 40]), rnd.choice(["", " ", "x", "'s ", "\n", " new words, here ", "é日", "   "])))
        rows.append((n, text, edits, "mine"))
    docs = spark.createDataFrame(rows, f"doc_id int, text string, edits {token_counts.EDITS}, reencoded_chars string")
    state = token_counts.index(docs, PATH)
    for r in state.collect():
        assert r.n_tokens == len(model.encode(r.text or "", special=False)) == sum(r.leaf_tokens)
        assert sum(r.leaf_chars) == len(r.text or "")
    found = {r.doc_id: r for r in token_counts.apply_edits(state, PATH).collect()}
    for n, text, edits, _ in rows:
        now = text or ""
        for a, b, insert in edits:
            a = min(max(a, 0), len(now))
            b = min(max(b, a), len(now))
            now = now[:a] + insert + now[b:]
        r = found[n]
        assert (r.text or "") == now and r.n_tokens == len(model.encode(now, special=False)) == sum(r.leaf_tokens)
        assert sum(r.leaf_chars) == len(now)
    big = [r for r in found.values() if r.text and len(r.text) > 20000]
    assert all(r.reencoded_chars < len(r.text) / 4 for r in big)


def test_edits_join_by_sequence_and_chain(spark, model):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (2, "four"), (None, None)], "doc_id bigint, text string")
    edits = spark.createDataFrame([(1, 2, 0, 3, "zero"), (1, 1, 0, 0, "a "), (2, 1, 4, None, " five")],
                                  "doc_id bigint, seq int, start int, stop int, insert string")
    once = token_counts.apply_edits(token_counts.with_edits(token_counts.index(docs, PATH), edits), PATH)
    assert sorted((r.text or "") for r in once.collect()) == ["", "four five", "four five", "zerone two three"]
    again = token_counts.apply_edits(once.withColumn("edits", F.expr("array(named_struct('start', 0, 'stop', 1, 'insert', 'X'))")), PATH)
    for r in again.collect():
        assert r.n_tokens == len(model.encode(r.text, special=False))


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.learn(docs, where=~langid.held_out())).withColumn("held", langid.held_out())
    rows = out.where("lang is not null and held").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.accepted for r in rows]) > 0.98


def test_language_id_cases(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (4, "the cat sat on the mat", "en"),
                                  (5, "le chat est sur la table", "fr"), (5, "le chat est sur la table", "fr")],
                                 "doc_id bigint, text string, lang string")
    model = langid.learn(docs)
    assert sorted(model) == ["en", "fr"]
    out = {(r.doc_id, r.lang_pred, r.accepted) for r in langid.identify(docs, model).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False)} < out and (4, "en", True) in out and (5, "fr", True) in out
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.learn(docs.limit(0)) == {} and langid.identify(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        langid.learn(docs, max_languages=1)


def test_line_dedup(spark):
    rows = [(n, "a", f"own {n}\nmenu \n\nmenu\nfoot") for n in range(8)] + [(8, "a", "own 8"), (9, "a", None), (10, None, "menu"),
            (11, "b", "menu\nfoot"), (12, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("n_lines", F.lit("clash"))
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, max_ratio=0.5, min_pages=3).collect()}
    assert out[3].kept_text == "own 3\n" and out[3].n_lines == 4 and out[3].n_dropped == 3
    assert out[9].kept_text is None and out[9].n_lines == 0 and out[10].kept_text == "menu" and out[11].kept_text == "menu\nfoot"
    assert out[12].kept_text == "" and out[12].n_lines == 0 and len(out) == 13
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_licences(spark):
    mit = dict(licenses.KNOWN)["MIT"]
    other = "Copyright (c) 2020 Somebody. All rights kept\n\n" + mit.upper().replace(",", " ;").replace("COPYRIGHT HOLDERS", "copyright owners")
    rows = [(1, mit), (2, other), (3, "words before\nReleased under the MIT Licence!\nafter\nreleased under the mit license"), (4, None), (5, ""),
            (5, ""), (None, mit), (6, mit + " more"), (7, "...")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license_id", F.lit("clash"))
    known = licenses.known_table(spark)
    out = licenses.scan(docs, known)
    got = sorted(((r.doc_id or 0, r.text_license, tuple(r.notices), r.n_notices) for r in out.collect()), key=str)
    assert got == [(0, "MIT", (), 0), (1, "MIT", (), 0), (2, "MIT", (), 0), (3, None, ("MIT-notice",), 2), (4, None, (), 0),
                   (5, None, (), 0), (5, None, (), 0), (6, None, (), 0), (7, None, (), 0)]
    by_id = {g[0]: g for g in got}
    assert by_id[2][1] == by_id[0][1] == "MIT" and by_id[3][2:] == (("MIT-notice",), 2) and by_id[6][1] is None
    assert licenses.scan(docs.limit(0), known).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _plain_form(text):
    kept = [line for line in text.lower().split("\n") if not re.match(r"[ \t]*(copyright\b|\(c\)|\xa9)", line)]
    words = re.findall(r"[^\W_]+", " ".join(kept))
    return " ".join(licenses.EQUIVALENT.get(w, w) for w in words)


def test_licences_equal_a_plain_version(spark):
    rng = random.Random(3)
    known = [("A", "The licence holder may organise it\nand copy."), ("B", "Wilful Offence"), ("C", "the LICENSE owner may organize it; and copy"),
             ("D", "copyright only")]
    forms = {}
    for name, text in known:
        if _plain_form(text):
            forms[_plain_form(text)] = min(name, forms.get(_plain_form(text), name))
    pieces = ["the licence holder may", "THE LICENSE owner  may", " organise it", "organize it,", "\n", "\n\n", "and copy", "and copy.", "wilful", "willful -- offense",
              "  (C) 2020 x", "Copyright y\n", "\u00a9 z", "copyrighted", " ", "...", "\t", "\r\n", "\u00e9t\u00e9", "9"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(600)]
    texts += [t for _, t in known] + ["and copy\nwilful offence\n\nWillful, offense.\n(c) wilful offence"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.text_license, r.notices, r.n_notices) for r in licenses.scan(docs, licenses.known_table(spark, known)).collect()}
    want = {}
    for i, t in enumerate(texts):
        lines = [forms[f] for f in map(_plain_form, t.split("\n")) if f in forms]
        want[i] = (forms.get(_plain_form(t)), sorted(set(lines)), len(lines))
    assert got == want and sum(w[0] is not None for w in want.values()) > 5 and sum(w[2] > 0 for w in want.values()) > 5


def test_licence_files_as_they_are_found(spark):
    texts = dict(licenses.KNOWN)
    bodies = {p.stem: p.read_text().partition("\n%%\n") for p in (pathlib.Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    rows = [("MIT", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + texts["MIT"]),
            ("MIT", "The MIT License (MIT)\nCopyright 2020 The Some Authors. All rights reserved.\n\n" + texts["MIT"]),
            ("ISC", "The ISC License\n\nCopyright (c) Some Body and Others\n" + texts["ISC"]),
            ("0BSD", "# Copyright (C) 2020 Some Body\n# All rights reserved.\n#\n" + re.sub("(?m)^", "# ", texts["0BSD"])),
            ("MIT", "/*\n * Copyright (c) 2020 Some Body\n *\n" + re.sub("(?m)^", " * ", textwrap.fill(texts["MIT"], 30)) + "\n */"),
            ("ISC", "dnl Copyright 2020 Some Body\n" + re.sub("(?m)^", "dnl ", textwrap.fill(texts["ISC"], 40))),
            (None, "MIT License\n\n" + texts["MIT"] + "\nor not"), (None, "Apache License Version 2.0, January 2004")]
    rows += [(n.split("@")[0], head.split("\n")[0] + "\n\nCopyright (c) 1999 Some Body\n\n" + body) for n, (head, _, body) in bodies.items()]
    rows += [(n.split("@")[0], body) for n, (_, _, body) in bodies.items()]
    # a licence is the same wherever its lines are broken
    rnd = random.Random(5)
    for n, (_, _, body) in bodies.items():
        body = body.partition("END OF TERMS")[0]
        rows += [(n.split("@")[0], "\n\n".join(p if re.search(r"(?i)copyright( \(c\)|  ?year)", " ".join(p.split())) else
                                              textwrap.fill(" ".join(p.split()), rnd.randint(25, 120), break_on_hyphens=False,
                                                            break_long_words=False)
                                              for p in body.split("\n\n"))) for _ in range(4)]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")
    got = {r.doc_id: r.text_license for r in licenses.scan(docs, licenses.known_table(spark)).collect()}
    assert [(want, rows[i][1][:60]) for i, (want, _) in enumerate(rows) if got[i] != want] == []
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(got.values())


def test_line_dedup_lets_the_ratio_decide_at_every_size_of_host(spark):
    rows = []
    for host, pages, carried in [("three", 3, 3), ("two", 2, 2), ("dozen", 12, 9), ("dozen-few", 12, 2), ("hundred", 50, 8), ("hundred-few", 50, 5),
                                 ("thousand", 1000, 101), ("thousand-few", 1000, 100)]:
        rows += [(host, f"own {n}\nmenu" if n < carried else f"own {n}") for n in range(pages)]
    docs = spark.createDataFrame(rows, "source string, text string")
    dropped = {r.source: r.n for r in line_dedup.drop_boilerplate(docs).groupBy("source").agg(F.sum("n_dropped").alias("n")).collect()}
    assert dropped == {"three": 3, "two": 0, "dozen": 9, "dozen-few": 0, "hundred": 8, "hundred-few": 0, "thousand": 101, "thousand-few": 0}


def test_the_tree_keeps_its_leaves_after_a_large_edit(spark):
    words = "some words of a long text, cut into leaves. "
    docs = spark.createDataFrame([(1, "short", [(2, 3, words * 2000)])], f"doc_id int, text string, edits {token_counts.EDITS}")
    once = token_counts.apply_edits(token_counts.index(docs, PATH), PATH)
    again = once.drop("edits").withColumn("edits", F.expr("array(named_struct('start', 40000, 'stop', 40001, 'insert', 'X'))"))
    got = token_counts.apply_edits(again, PATH).first()
    assert got.reencoded_chars < 1000
    whole = token_counts.index(spark.createDataFrame([(1, got.text)], "doc_id int, text string"), PATH).first()
    assert got.n_tokens == whole.n_tokens and sum(got.leaf_chars) == len(got.text) and sum(got.leaf_tokens) == got.n_tokens


def test_signs_that_are_no_letters_have_no_language(spark):
    model = {"de": langid.fold(b"der die das und ist nicht ein " * 50), "en": langid.fold(b"the of and to in is that " * 50)}
    rows = [(i, t) for i, t in enumerate(["\u00bd", "\u00b2", "\u2460", "\u2167", "12 3", "_", "", None, "x", "\u00e9", "\u65e5"])]
    got = langid.identify(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in got} == {i: i < 8 for i in range(len(rows))}


def test_prediction_equals_a_plain_loop(spark):
    """Every text compressed with every dictionary, block by block."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs, where=~langid.held_out())
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), model).collect()}
    names = sorted(model)
    for d in docs.collect():
        if not (d.text and any(c.isalpha() for c in d.text)):
            continue
        folded = "".join(c if not c.isascii() else c.lower() if c.isalpha() else " " for c in d.text)
        raw = b" " + b" ".join(folded.encode().split()) + b" "
        for level in (3, 12):
            sizes = []
            for n in names:
                words = zstandard.ZstdCompressionDict(model[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=level)
                c = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)
                sizes.append(sum(len(c.compress(raw[i:i + 2048])) for i in range(0, len(raw), 2048)))
            first, second = sorted(sizes)[:2]
            if 1 - first / second >= 0.09:
                break
        assert got[d.doc_id].lang_pred == names[sizes.index(first)] and got[d.doc_id].score == pytest.approx(1 - first / second)


def test_line_ends_do_not_tell_lines_apart(spark):
    rows = [(i, "h", f"own {i}\n" + end.join(["menu", ""])) for i, end in enumerate(["\n", "\r\n", "\t\r\n", " \n"])] + [(9, "h", None)]
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id int, source string, text string")).collect()}
    assert [out[i].n_dropped for i in range(4)] == [1] * 4 and [out[i].n_lines for i in range(4)] == [2] * 4


def test_the_query_equals_the_pipeline_stage(spark):
    import corpus_pipeline
    from crateflow.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = {r.doc_id: r.d for r in corpus_pipeline.drop_site_lines(spark, docs, sf).select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("d")).collect()}
    assert {r.doc_id: r.kept_sha256 for r in queries.op1_line_dedup(spark, sf).collect()} == stage


def test_the_prefix_tree_is_that_of_all_prefixes_and_takes_little_to_build(model):
    import tracemalloc

    nodes, edges = {b"": 0}, {}
    for t in sorted(model.ids):
        for n in range(1, len(t) + 1):
            if t[:n] not in nodes:
                nodes[t[:n]] = len(nodes)
                edges[nodes[t[:n - 1]] << 8 | t[n - 1]] = nodes[t[:n]]
    assert dict(zip(model.edge.tolist(), model.child.tolist())) == edges and model.edge.tolist() == sorted(edges)
    assert {n: model.completes[i] for n, i in nodes.items() if model.completes[i] >= 0} == model.ids
    tracemalloc.start()
    model._index_prefixes()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * 8 * len(nodes)  # a few arrays of numbers


def test_tasks_get_the_arrays_of_the_encoder_and_not_its_dictionaries(spark, model, library):
    import pickle

    model.encode(ODD[7])  # a long word: its merges are looked up in a dictionary
    sent = pickle.loads(pickle.dumps(model))
    assert not {"token", "ids", "merge"} & set(vars(sent)) and not len(sent.cache.h)
    made = [v for v in vars(sent).values() if isinstance(v, (dict, list))]
    assert sum(map(len, made)) < 100  # the special tokens
    for text in ODD:
        want = library.encode(text, add_special_tokens=False).ids
        assert sent.encode(text).tolist() == want
        assert sent.decode(want) == library.decode(want, skip_special_tokens=False)
    assert isinstance(bpe.shared_model(spark, PATH)(), bpe.ByteBpe)  # built on the driver, not from the file in a task
    assert not hasattr(bpe, "_load")
