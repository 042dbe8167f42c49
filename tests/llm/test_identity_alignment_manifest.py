"""Language ID by held-out accuracy, alignment and the Merkle manifest against brute force, all on awkward tables too."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkroost import session
from sparkroost.llm import language_id, merkle, token_alignment
from tests.conftest import DATA

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
#: Extra columns take the names that the operators use inside.
ODD = "doc_id long, text string, lang string, source string, n_chars long, g string, id string, leaf string, rank long, path string, held string, score string, doc string, run string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, n, "g", "i", "l", 5, "p", "h", "s", "d", "r") for i, t, lang, source, n in rows], ODD)


def awkward():
    same = "The quick brown fox\njumps over the lazy dog"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, same), (6, same), (6, same), (6, same + "!"), (None, same), (None, None), (None, same), (7, LONG), (-9, "Ünï— 日本 " * 20), (1 << 62, "12 34 !?"), (-(1 << 63), "a\nb")]
    return [(i, t, "en" if k % 3 else None, (None, "", "s", "é")[k % 4], None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    session.ship(spark)


# --- language ID -------------------------------------------------------------------------------------------------


def test_held_out_languages_are_known(spark):
    got = language_id.op11_language_id(spark, DATA.replace("0.001", "0.01"))
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    accepted = [r for r in held if r.accepted]
    assert len(accepted) > 0.8 * len(held) and np.mean([r.lang == r.lang_pred for r in accepted]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_awkward_and_empty_tables(spark):
    rows = [(i, t, lang, "s", 1) for i, t, lang in [(1, "la maison est ici", "fr"), (2, "the house is here", "en"), (3, None, "en"), (4, "", "fr"), (5, "123 !?", "en"), (6, "日本語", None), (None, "the house", "en"), (8, LONG, "en"), (9, "the house is here", "en"), (9, "the house is here", "en")]]
    rng = random.Random(1)
    words = {"fr": "la maison le jardin est ici une petite avec des fleurs qui".split(), "en": "the house a garden is here small with some flowers which".split()}
    more = [(100 + k, " ".join(rng.choices(words[lang], k=12)), lang, "s", 1) for k, lang in enumerate(["fr", "en"] * 60)]
    docs = table(spark, rows)
    model = language_id.train(table(spark, rows + more))
    assert model.languages == ["en", "fr"]
    out = {(r.doc_id, r.lang_pred, r.accepted is not None): r.score for r in model.predict(docs).collect()}
    found = [(k[0], k[1]) for k in out]
    assert {(3, "und"), (4, "und"), (5, "und"), (1, "fr"), (2, "en"), (None, "en"), (8, "en"), (9, "en")} <= set(found)
    assert all(s == 0 for (i, lang, _), s in out.items() if lang == "und")
    assert model.predict(docs).count() == len(rows)
    # no labelled row: nothing is learned, every text is unknown
    none = language_id.train(docs.where("lang is null"))
    assert {(r.lang_pred, r.score, r.accepted) for r in none.predict(docs).collect()} == {("und", 0.0, False)}
    assert model.predict(docs.limit(0)).collect() == []


def test_rates_do_not_depend_on_the_batch(spark):
    import pyarrow as pa

    from sparkroost.llm._words import pack

    table_ = np.random.default_rng(1).normal(size=(language_id.BUCKETS, 3))
    texts = ["Der Hund, der da war.", "", "x", "the cat sat on the mat", "été", "Der Hund"]
    whole = language_id.rate(table_, *pack(pa.array(texts)))
    for i, t in enumerate(texts):
        assert (language_id.rate(table_, *pack(pa.array([t])))[0] == whole[i]).all()


def test_the_threshold_meets_its_error():
    rng = np.random.default_rng(3)
    label = rng.integers(0, 3, 3000)
    z = rng.normal(size=(3000, 3)) + 3 * np.eye(3)[label]
    temperature, least = language_id.calibrated(z, label)
    p = language_id.softmax(z / temperature)
    sure = p.max(1) >= least
    assert 0 < sure.sum() < 3000 and (p.argmax(1) != label)[sure].mean() <= language_id.ERROR
    # calibrated: the mean probability of the answers is their accuracy
    assert abs(p.max(1).mean() - (p.argmax(1) == label).mean()) < 0.02


# --- alignment ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabularies():
    return pytest.importorskip("public_tokenizers")


def brute_alignment(P, rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from sparkroost.llm.token_files import byte_chars

    chars = byte_chars()
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        of_a = {i: bytes(chars[c] for c in x) for x, i in json.load(f)["model"]["vocab"].items()}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    of_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]
    docs, totals = [], Counter()
    for i, text in rows:
        links, said, a, b = [], [], [], []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            if not b"".join(of_a[x] for x in a) == (" " + text).encode() == b"".join(of_b[x] for x in b):
                a = b = []
        ends = [np.cumsum([len(of[x]) for x in ids]).tolist() for of, ids in ((of_a, a), (of_b, b))]
        place = [{e: k + 1 for k, e in enumerate(own)} for own in ends]
        x = y = 0
        for e in sorted(place[0].keys() & place[1].keys()):
            p, q = place[0][e], place[1][e]
            said.append(",".join(map(str, a[x:p])) + "|" + ",".join(map(str, b[y:q])))
            links.append((a[p - 1], b[q - 1]))
            x, y = p, q
        totals.update(links)
        docs.append((i, len(a), len(b), len(said), links, ";".join(said)))
    best = Counter()
    for (_, b), n in totals.items():
        best[b] = max(best[b], n)
    return sorted((str(i), na, nb, g, len(k), sum(totals[x] == best[x[1]] for x in k), sum(totals[x] for x in k), hashlib.sha256(said.encode()).hexdigest() if na else "") for i, na, nb, g, k, said in docs)


def aligned(spark, P, rows):
    docs = table(spark, [(i, t, "en", "s", 1) for i, t in rows]).repartition(3)
    out = token_alignment.documents(token_alignment.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")))
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect())


def test_alignment_equals_brute_force(spark, vocabularies, monkeypatch):
    rng = random.Random(11)
    signs = ["a", "the", "Ünï", " ", "  ", "\n", "\t", "\r\n", "\r", ";\r", "\x0b", " ", "　", "▁", "<|endoftext|>", "</s>", "<0x0A>", "x", "23", ".", "日本", "😀", "\x00", "'s", "ing", "́", "﻿", "\x85"]
    rows = [(k, "".join(rng.choices(signs, k=rng.randint(0, 25)))) for k in range(900)]
    rows += [(i, t) for i, t, *_ in awkward()] + [(-3, " " * 3000), (-4, "a" * 3000), (-5, "😀" * 500)]
    assert aligned(spark, vocabularies, rows) == brute_alignment(vocabularies, rows)


def test_a_full_memo_begins_anew(vocabularies, monkeypatch):
    import pyarrow as pa

    texts = pa.array([f"word{i} other{i % 7}, and " + "more " * (i % 3) for i in range(400)])
    paths = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")
    whole = token_alignment.Aligner(*paths).block(texts)
    monkeypatch.setattr(token_alignment, "MEMO_RUNS", 60)
    monkeypatch.setattr(token_alignment, "LEARN_RUNS", 17)
    own = token_alignment.Aligner(*paths)
    parts = [own.block(texts.slice(i, 50)) for i in range(0, 400, 50)]
    assert sum((p[1] for p in parts), []) == whole[1]
    for k in whole[0]:
        assert np.concatenate([p[0][k] for p in parts]).tolist() == whole[0][k].tolist()


def test_overlaps_are_all_pairs_that_share_bytes(vocabularies):
    import pyarrow as pa

    own = token_alignment.Aligner(vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model"))
    text = "Zusammengesetzte Wörter, unbelievably; 日本"
    sums, _, _ = own.block(pa.array([text]))
    spans = []
    for ids, of in ((own.a.library.encode(" " + text, add_special_tokens=False).ids, own.a_bytes), (own.b.library.encode(text), own.b.bytes)):
        end = np.cumsum([len(of[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *end[:-1]], end, strict=True)))
    assert sums["n_overlaps"][0] == sum(a < d and c < b for a, b in spans[0] for c, d in spans[1])


def test_alignment_of_an_empty_table(spark, vocabularies):
    assert aligned(spark, vocabularies, []) == []


# --- Merkle manifest ---------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, tamper):
    leaf_of = lambda values: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
    fields = lambda r, t: (r[0], r[3], r[2], r[4], t)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def siblings(tree, i):
        for level in tree[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            yield "".join(run[: i % 3]), "".join(run[i % 3 + 1 :])
            i //= 3

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(fields(r, r[1])), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            node = leaf_of(fields(r, tamper(r)))
            for a, b in path:
                node = H(a, node, b)
            out.append((str(r[0]), leaf, trees[s][-1][0], top[-1][0], H(*(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out)


def manifest(spark, rows, **how):
    docs = table(spark, rows).repartition(3)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.manifest(docs, tampered, **how).collect())


def tampered(r):
    return r[1] if r[1] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[1].replace("\n", "")


def test_manifest_equals_brute_force(spark):
    rng = random.Random(2)
    many = [(rng.choice([k, rng.getrandbits(63) - (1 << 62)]), rng.choice(["a\nb", "c", None, "é\n\n"]), "en", rng.choice(["hot", "hot", None, "", "z", "Z", "é"]), k) for k in range(1300)]
    rows = awkward() + many + [(5, "copy\n", "en", "hot", 1)] * 300 + [(None, f"n{k}", "en", "hot", 1) for k in range(300)]
    want = brute_manifest(rows, tampered)
    assert manifest(spark, rows) == want
    # crowded prefixes are cut on by digits of the leaves
    assert manifest(spark, rows, cell_rows=10) == want
    assert {x[-1] for x in want} == {True, False}


def test_small_manifests(spark):
    for rows in ([(1, "only\n", "en", None, 2)], [(1, "a", "en", "s", 1), (2, "b", "en", "s", 1)], [(1, "a", "en", f"s{k}", 1) for k in range(10)], [(None, None, None, None, None)] * 4):
        assert manifest(spark, rows) == brute_manifest(rows, tampered)
    assert manifest(spark, []) == []


def test_a_proof_is_that_of_its_row(spark):
    rows = merkle.manifest(table(spark, [(k, f"t{k}", "en", "s", 1) for k in range(9)])).collect()
    assert all(r.verified and len(r.path) == 2 and r.source == "s" for r in rows)


def test_regenerated_answers_take_time_in_proportion():
    import time

    from sparkroost.llm import chat_format

    fold = chat_format._Fold()
    began = time.monotonic()
    for k in range(60_000):
        fold.event(2 * k, "start", "user", f"q{k}")
        fold.event(2 * k + 1, "start", "assistant", "first")
        fold.event(2 * k + 1, "regenerate", None, None)
        fold.event(2 * k + 1, "delta", None, "second")
    fold.event(3, "regenerate", None, None)
    assert time.monotonic() - began < 10
    assert fold.result() == [("user", "q0"), ("assistant", "second"), ("user", "q1"), ("assistant", "")]
