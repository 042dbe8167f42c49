"""Operators against brute force, exact round trips and held-out labels, and on awkward tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkroost.llm import _shared, _words, anisotropic_index, chat_format, components, decontaminate, jaccard_dedup, lm_score, quality, queries, simhash_dedup, substring_dedup, token_files, toxicity, word_lexicon
from tests.conftest import DATA

ODD = "doc_id long, text string, lang string, fp string, block int, low long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "f", 3, 9) for i, t in rows], ODD)


def awkward():
    same = "the quick brown fox jumps over the lazy dog and then runs back home again today"
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, same), (6, same), (6, same), (None, same), (7, LONG), (8, LONG + " tail"), (9, "Ünï— 日本 " * 20), (10, same + " and more")]


def brute_repeats(rows, n=13):
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: -(1 << 63) if i is None else i
    low: dict = {}
    for i, w in cut:
        for p in range(len(w) - n + 1):
            g = tuple(w[p : p + n])
            low[g] = min(low.get(g, key(i)), key(i))
    out = []
    for i, w in cut:
        gone = set()
        for p in range(len(w) - n + 1):
            if low[tuple(w[p : p + n])] < key(i):
                gone |= set(range(p, p + n))
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((str(i), len(w), len(gone), kept.decode()))
    return sorted(out)


def test_substring_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"t{k}" for k in range(40)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    rows = awkward() + [(100 + i, " ".join([rng.choice(base), *rng.choices(words, k=20), rng.choice(base)[30:]])) for i in range(40)]
    for sizes in ({}, {"group_suffixes": 20, "block_bytes": 3000}):
        got = substring_dedup.remove_repeats(docs(spark, rows), **sizes).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows)
    whole = substring_dedup.rewrite(docs(spark, rows))
    assert whole.columns == ["doc_id", "text", "lang", "fp", "block", "low", "n_removed"]
    assert sorted(str(r.doc_id) for r in whole.collect()) == sorted(str(i) for i, _ in rows)
    assert [r.text for r in whole.where("doc_id = 1").collect()] == [None]


def test_subtree_finds_common_prefixes():
    import pyarrow as pa

    text = np.array([[0, 1, 2, 5], [0, 1, 2, 5], [0, 1, 3, 5], [2, 2, 2, 2]], np.uint32).T
    head = (text[0].astype(np.uint64) << np.uint64(32)) | text[1]
    table = pa.table({"bucket": [0], "block": [7], "n": [4], "head": [_words.to_gaps(head)], "rest": [text[2:].tobytes()], "low": [_words.to_plane(np.array([5, 3, 1, 2], np.int64))], "count": [_words.to_plane(np.ones(4, np.uint32))]})
    tree = substring_dedup._Subtree(table)
    assert tree.lcp.tolist() == [0, 4, 2, 0]
    assert tree.nodes(4).tolist() == [0, 2, 3] and tree.nodes(2).tolist() == [0, 3]
    assert np.unpackbits(np.frombuffer(substring_dedup._resolve(table).column("bits")[0].as_py(), np.uint8), count=4).tolist() == [1, 0, 0, 0]


def test_hot_prefixes_are_extended(spark, monkeypatch):
    """A word that is every second one: its suffixes are spread over groups by longer prefixes."""
    rng = random.Random(3)
    rows = [(i, " ".join(x for _ in range(60) for x in ("the", f"w{rng.randint(0, 9)}"))) for i in range(30)]
    seen = []
    real = substring_dedup._send_suffixes
    monkeypatch.setattr(substring_dedup, "_send_suffixes", lambda n, bits, screen, hot, groups: seen.append(hot.value) or real(n, bits, screen, hot, groups))
    got = substring_dedup.remove_repeats(docs(spark, rows), group_suffixes=20, block_bytes=3000).collect()
    assert len(seen[0]) >= 2 and len(seen[0][0]) >= 1
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows)


def test_two_steps_of_exchange_give_the_same(spark):
    """Buckets too large for a task: runs, parts of buckets, answers translated back."""
    rng = random.Random(12)
    words = [f"t{k}" for k in range(30)]
    base = [" ".join(rng.choices(words, k=50)) for _ in range(5)]
    rows = awkward() + [(100 + i, " ".join([rng.choice(base), *rng.choices(words, k=15), rng.choice(base)[25:]])) for i in range(40)]
    table = docs(spark, rows)
    got = substring_dedup._run(table, "doc_id", "text", 13, 30, 3000, False, fan=4, range_windows=500, run_items=700).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(rows)
    key = lambda r: (str(r.doc_id), r.n_words, r.n_full, round(r.log10_score, 6))
    one = sorted(map(key, lm_score.score(table).collect()))
    assert sorted(map(key, lm_score.score(table, block_bytes=3000, fan=4, range_words=500, run_items=700).collect())) == one


def brute_groups(fps, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (int(fps[a]) ^ int(fps[b])).bit_count() <= 2:
                x, y = root(ids[a]), root(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("list_rows", [512, 3])
def test_links_equal_brute_force(spark, list_rows):
    rng = np.random.default_rng(3)
    fps = list(rng.integers(0, 1 << 63, 20).astype(np.uint64))
    while len(fps) < 150:  # chains of one to three bits
        x = int(fps[rng.integers(len(fps))])
        for _ in range(rng.integers(1, 4)):
            x ^= 1 << int(rng.integers(64))
        fps.append(np.uint64(x))
    fps = np.unique(np.array(fps, np.uint64))
    ids = list(range(10, 10 + len(fps)))
    prints = spark.createDataFrame(list(zip(fps.view(np.int64).tolist(), ids, strict=True)), "fp long, low long")
    held = dict(map(tuple, components.components(simhash_dedup.links(prints, list_rows)).collect()))
    assert {i: held.get(i, i) for i in ids} == brute_groups(fps, ids)


def test_simhash_awkward_rows(spark):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash_dedup.near_duplicates(docs(spark, awkward())).collect()}
    zero = "0" * 16
    assert got[(1, zero)] == got[(2, zero)] == got[(3, zero)] == 1
    assert {v for (i, _), v in got.items() if i in (5, 6, None)} == {5}


def test_simhash_rows_without_an_id_link_and_bridge(spark, monkeypatch):
    # one bit apart, in a chain: 9 - null - 5, and a group without any id
    prints = [(9, 0b0011), (None, 0b0111), (5, 0b11111), (None, 1 << 40), (None, 1 << 41), (7, -1)]
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda *_: spark.createDataFrame(prints, "doc_id long, fp long"))
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash_dedup.near_duplicates(None).collect())
    assert got == {(9, 5): 1, (None, 5): 1, (5, 5): 1, (None, None): 2, (7, 7): 1}


def brute_similar(texts):
    """Index of each text's group: links are exact Jaccard >= 0.8 of sets of five-word shingles."""
    cut = [[w.lower() for w in (t or "").encode().split()] for t in texts]
    own = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in cut]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(own))]


def test_jaccard_groups_equal_brute_force(spark):
    rng = random.Random(8)
    line = "this very common line stands in a great many of the texts here"
    texts = [t for _, t in awkward()] + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for n in (3, 6, 24, 60, 200):
        base = [f"v{k}" for k in rng.choices(range(5000), k=n)]
        for _ in range(12):  # copies with edits, on both sides of the bound
            w = list(base)
            for _ in range(rng.randint(0, 1 + n // 50)):
                w[rng.randrange(n)] = f"e{rng.random()}"
            texts.append(" ".join(w))
            texts.append(" ".join([line, *(f"u{rng.random()}" for _ in range(rng.randint(0, 9)))]))
    got = dict(map(tuple, jaccard_dedup.groups(spark.createDataFrame(list(enumerate(texts)), "key long, text string")).collect()))
    first = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    assert [first[got[i]] for i in range(len(texts))] == brute_similar(texts)
    assert len(got) == len(texts)


def test_near_duplicate_stage_goes_by_similarity(spark):
    import corpus_pipeline

    base = [f"v{k}" for k in range(100)]
    near, far = [*base[:50], "changed", *base[51:]], [*base[:50], *(f"x{k}" for k in range(50))]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    assert (simhash_dedup.fingerprint(rows[0][1].encode()) ^ simhash_dedup.fingerprint(rows[1][1].encode())).bit_count() > 2
    left = corpus_pipeline.near_duplicate(spark, docs(spark, rows), DATA)
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_stages_decide_by_row(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"{k}t{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("b")), (None, text("a")), (None, text("c")), (3, text("d")), (3, text("d"))]
    left = corpus_pipeline.near_duplicate(spark, docs(spark, rows), DATA)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("1", text("a")), ("1", text("b")), ("None", text("c")), ("3", text("d"))])
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 100").first().text
    rows = [(1, f"{text('a')} {item} {text('b')}"), (1, text("c")), (None, item), (None, text("d"))]
    left = corpus_pipeline.decontaminate(spark, docs(spark, rows), DATA)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("1", text("c")), ("None", text("d"))]


def test_chat_round_trip_and_fold(spark):
    events = [(1, 1, 1, "start", "user", "hi"), (1, 2, 2, "start", "assistant", ""), (1, 3, 2, "delta", None, "a"), (1, 4, 3, "start", "user", "x"), (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "b"), (1, 7, 2, "delta", None, "</s>"), (1, 8, 1, "edit", None, "ho"), (2, 1, 9, "start", None, None), (2, 2, 9, "delete", None, None), (None, 1, 1, "odd", None, None)]
    out = {r.conv_id: r for r in chat_format.format_events(spark.createDataFrame(events, "conv_id long, seq int, message long, kind string, role string, text string")).collect()}
    assert chat_format.parse(out[1].formatted) == [("user", "ho"), ("assistant", "b</s>")]
    assert [chat_format.unescape(out[1].formatted[s.start : s.end]) for s in out[1].loss] == ["b</s>"]
    assert out[2].n_turns == out[None].n_turns == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\"]), st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "\n", "x", "<", "[", "é"]), max_size=8).map("".join))))
def test_chat_text_is_reversible(messages):
    formatted, spans = chat_format.render(messages)
    assert chat_format.parse(formatted) == messages
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant"]


HARD = ["", " ", "  a  b \n\n c", "\tx\r\n", "a<|endoftext|>b", "it's 'tis I'LL don't", "".join(map(chr, range(32, 0x250))), "naïve—test ’s…", "\x1c\x1d a", "日本語 text", "é a", "Σας ΟΔΟΣ İstanbul", "ab" * 500, "\xa0\xa0a\x85b", "12 345,6!!..??\n\n", "a<|startoftext|> b"]


def test_token_files_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(50 - i, t) for i, t in enumerate(HARD)] + [(200, None), (200, "again"), (None, "no id")]
    folder = _shared.scratch(spark, "tokens")
    manifest = token_files.write_tokens(docs(spark, rows), folder, path)
    got = token_files.read_index(manifest, folder).collect()
    want = {(i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows}
    assert {(r.doc_id, r.ids_crc32) for r in got} == want and len(got) == len(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)


def test_word_lexicon_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(HARD)] + [(90, None), (91, "frequent frequent words words")]
    for n_words in (0, 100):
        for r in word_lexicon.encode_decode(docs(spark, rows), path, n_words=n_words).collect():
            ids = library.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == ids
            assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = {w: [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "é", ""])}
    f = tmp_path / "lexicon"
    f.write_bytes(word_lexicon.compile_lexicon(words))
    lexicon = word_lexicon.Lexicon(str(f))
    assert [x.tolist() for x in lexicon.lookup([w.encode() for w in words])] == list(words.values())
    assert lexicon.lookup([b"ta", b"tapss", b"x"]) == [None] * 3
    assert len(lexicon.end) == 6  # root, t, a|o, p, s, the first byte of é: suffixes are shared


def test_neighbours_recall_and_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[500:900] = x[500]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0]), (9004, [None] * 16), (9100, [float("inf")] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = anisotropic_index.search(table, table.where("vec_id % 100 = 0")).collect()
    hits = total = 0
    for q in {r.query_id for r in got}:
        own = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        hits += len({v for v, _ in own} & set(want.tolist()))
        total += 10
        assert all(s == pytest.approx(d[v]) for v, s in own) and [s for _, s in own] == sorted(s for _, s in own)
    assert total == 300 and hits / total >= 0.9
    assert anisotropic_index.search(table.limit(0), table.limit(0)).count() == 0


def test_subsequence_length():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(1, 6) for _ in range(rng.randint(1, 25))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontaminate.common(decontaminate._masks(a), len(a), b) == row[-1]


def test_decontaminate_finds_copies_and_paraphrases(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    items = [(k, " ".join(word() for _ in range(30)) + ".") for k in range(20)] + [(99, None), (98, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, filler(200)) for i in range(60)]
    for k in range(10):
        w = items[k][1].split()
        rows.append((100 + k, f"{filler(70)} {items[k][1]} {filler(50)}"))
        rows.append((200 + k, f"{filler(40)} {' '.join(filler(1) if j % 6 == 3 else x.upper() for j, x in enumerate(w))} {filler(90)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, rows + awkward()), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(b + k, k) for k in range(10) for b in (100, 200)}
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def brute_leaks(rows, items):
    """(doc_id, item_id) by the subsequence and answer checks alone: every region of one and a half times a passage,
    wherever it begins. Passages of which a text has too few words in all are left out first."""
    own = decontaminate.passages_of(items)
    vocabulary = np.unique(np.concatenate([p.h for p in own]))
    code = {int(h): i + 1 for i, h in enumerate(vocabulary)}
    for p in own:
        p.code(vocabulary)
    bags = [collections.Counter(p.codes) for p in own]
    found = set()
    for i, text in rows:
        w = [code.get(int(h), 0) for h in decontaminate._hashes(text)]
        bag = collections.Counter(w)
        for p, words in zip(own, bags, strict=True):
            if sum(min(n, bag[c]) for c, n in words.items()) < p.need:
                continue
            size = math.ceil(1.5 * len(p.codes))
            for a in range(max(1, len(w) - size + 1)):
                part = w[a : a + size]
                if decontaminate.common(p.masks, len(p.codes), part) >= p.need and decontaminate.common(p.answer_masks, len(p.answer), part) >= decontaminate.ANSWER * len(p.answer):
                    found.add((i, p.item))
                    break
    return found


def test_decontaminate_finds_spread_paraphrases_at_every_offset(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    items = [(k, " ".join(word() for _ in range(64)) + ".") for k in range(4)]
    rows = []
    for k, text in items:
        spread = []
        for j, x in enumerate(text.split()):
            spread.append(word() if j % 4 == 1 and j < 52 else x)
            spread += [word()] if j % 2 else []
        for offset in range(0, 34):
            rows.append((1000 * k + offset, " ".join([*(word() for _ in range(offset)), *spread, *(word() for _ in range(40))])))
    got = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame([*items, (None, items[0][1])], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i // 1000) for i, _ in rows} == brute_leaks(rows, items)
    assert sum(r.by_cosine for r in got) >= 0.9 * len(got)


def test_decontaminate_equals_brute_force_beyond_the_rank(spark):
    rng = random.Random(6)
    pool = [f"p{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(pool, k=rng.choice((8, 9, 12, 40))))) for k in range(1200)]
    rows = [(k, " ".join([*rng.choices(pool, k=70), t, *rng.choices(pool, k=60)])) for k, t in items[::8]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, rows), bench).collect()
    want = brute_leaks(rows, items)
    assert {(k, k) for k, _ in rows} <= want
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_decontaminate_finds_paraphrases_without_the_rare_words(spark):
    rng = random.Random(9)
    common = [f"c{k}" for k in range(60)]
    items, rows = [], []
    for k in range(20):
        w = [rng.choice(common) if j % 4 else f"rare{k}x{j}" for j in range(48)]
        items.append((k, " ".join(w)))
        other = [x if x in common else f"other{k}y{j}" for j, x in enumerate(w)]
        rows.append((k, " ".join([*rng.choices(common, k=50), *other, *rng.choices(common, k=50)])))
    got = decontaminate.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(rows, items) == {(k, k) for k in range(20)}


def test_classifiers_on_labelled_documents(spark):
    sf = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = queries.QUERIES["op8_quality"](spark, sf).drop("quality").join(labels, "doc_id")
    assert kept.where("(quality = 1) <> kept").count() <= 0.05 * kept.count()
    table = spark.read.parquet(f"{sf}/documents.parquet")
    seen = labels.where("doc_id % 3 <> 0")
    chain = toxicity.train(table, seen.select("doc_id", "toxic"), {"toxic": F.col("toxic") == 1})
    held = chain.score(table).join(labels.where("doc_id % 3 = 0"), "doc_id")
    assert held.where("toxic = 0 and p_toxic >= 0.5").count() <= 2
    assert held.where("toxic = 1 and p_toxic >= 0.5").count() >= 0.4 * held.where("toxic = 1").count()


def test_label_model_finds_the_bad_labeller():
    rng = np.random.default_rng(0)
    truth, accuracy = rng.random(4000) < 0.7, [0.95, 0.9, 0.9, 0.55]
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) for a in accuracy], 1).astype(int)
    pattern, count = np.unique(votes @ 3 ** np.arange(4), return_counts=True)
    post, table, share = quality.label_model(pattern, count.astype(float), 4)
    assert abs(share - 0.7) < 0.05 and table[0, 1, 1] > 0.9 > 0.65 > table[3, 1, 1]


def test_awkward_and_empty_tables(spark):
    table, none = docs(spark, awkward()), docs(spark, [(1, "x")]).limit(0)
    assert lm_score.score(table).count() == len(awkward()) and lm_score.score(none).count() == 0
    assert quality.train(table).keep(table).columns == table.columns
    assert quality.train(none).rate(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == simhash_dedup.near_duplicates(none).count() == 0
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 1), (4, 0), (77, 1)], "doc_id long, toxic int")
    chain = toxicity.train(table, labels, {"toxic": F.col("toxic") == 1})
    assert chain.score(table).count() == len(awkward()) and chain.score(none).count() == 0
    import public_tokenizers

    assert word_lexicon.encode_decode(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    folder = _shared.scratch(spark, "tokens")
    assert token_files.read_index(token_files.write_tokens(none, folder, public_tokenizers.path("byte_bpe_50k.json")), folder).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, DATA).toPandas(), c.execute(queries.ORACLES[name]).fetchdf()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert sorted(map(repr, ours[columns].itertuples(index=False, name=None))) == sorted(map(repr, theirs[columns].itertuples(index=False, name=None)))


def test_pipeline(spark):
    import corpus_pipeline

    first = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).collect()
    assert 0 < len(out) <= first.count() and len({r.doc_id for r in out}) == len(out)
    twice = first.unionByName(first.limit(5))
    one = corpus_pipeline.near_duplicate(spark, twice, DATA)
    assert one.columns == first.columns and one.count() == one.select("doc_id").distinct().count()
    digest = {r.doc_id: hashlib.sha256(r.ids).hexdigest() for r in out}
    assert len(digest) == len(out)


def test_fingerprint_equals_its_definition():
    import xxhash

    for text in (t or "" for _, t in awkward()[:-4]):
        w = [x.lower() for x in text.encode().split()]
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash_dedup.fingerprint(text.encode()) == want


def test_components_of_large_ids(spark):
    top = (1 << 63) - 1
    links = [(top - i, top - i - 1) for i in range(40)] + [(-(1 << 63), 5), (5, None), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[top - i] for i in range(41)} == {top - 40} and got[5] == -(1 << 63) and 7 not in got


def test_chat_ties_long_texts_and_empty_logs(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 3, "assistant", LONG), (None, 1, "user", "x"), (None, 1, "user", "y")]
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, message long")
    out = {r.conv_id: chat_format.parse(r.formatted) for r in chat_format.format_events(chat_format.events_of(turns), in_order=True).collect()}
    assert out == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], 2: [("assistant", LONG)], None: [("user", "x"), ("user", "y")]}
    assert chat_format.format_events(chat_format.events_of(turns.limit(0)), in_order=True).count() == 0


def test_neighbours_of_clusters_offsets_and_outliers(spark):
    """Rows that the codes can't tell apart, or that are unlike the sample, lose no neighbour."""
    rng = np.random.default_rng(5)
    tight = rng.standard_normal((4, 8))[rng.integers(0, 4, 1600)] + 1e-4 * rng.standard_normal((1600, 8))
    shifted = 1000 + 0.01 * rng.standard_normal((1600, 8))
    wide = rng.standard_normal((1600, 8)) * 10.0 ** rng.integers(-3, 25, (1600, 1))
    for x in (tight, shifted, wide):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in anisotropic_index.search(table, table.where("vec_id % 100 = 0"), fit_rows=400).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert len(got) == 16
        for q, own in got.items():
            d = np.sqrt(np.add.accumulate((x - x[q]) ** 2, axis=1)[:, -1])
            d[q] = np.inf
            want = np.lexsort((np.arange(len(x)), d))[:10]
            assert sorted(own) == [(i + 1, v, d[v]) for i, v in enumerate(want.tolist())]


def test_neighbours_ties_and_repeated_ids(spark):
    rows = [(i, [1.0, float(i % 3)], 1) for i in range(12)] + [(3, [1.0, 0.0], 2), (0, [1.0, 0.5], 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = [(r.rank, r.vec_id, r.score) for r in anisotropic_index.search(table, table.where("vec_id = 0")).collect()]
    assert sorted(got)[:4] == [(1, 3, 0.0), (2, 3, 0.0), (3, 6, 0.0), (4, 9, 0.0)] and len(got) == 10


def test_token_files_hold_every_id_and_long_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, least = public_tokenizers.path("byte_bpe_50k.json"), -(1 << 63)
    folder = _shared.scratch(spark, "tokens")
    manifest = token_files.write_tokens(docs(spark, [(least, LONG), (None, "none"), (0, "zero")]), folder, path)
    got = {r.doc_id: r.n_tokens for r in token_files.read_index(manifest, folder).collect()}
    n = lambda t: len(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) + 1
    assert got == {least: n(LONG), None: n("none"), 0: n("zero")}


def test_chunks_compare_every_byte():
    from sparkroost.llm import _chunks

    rng = random.Random(2)
    runs = ["a", "a\0", "\0a", "x" * 16, "x" * 17, "x" * 15 + "y", "yx" * 20, "é" * 8, "é" * 9]
    texts = [" ".join(rng.choices(runs, k=rng.randint(0, 30))) + rng.choice(["", " ", "\n "]) for _ in range(50)]
    import pyarrow as pa

    data, offsets = _words.pack(pa.array(texts))
    for lead in (False, True):
        begin, end, first = _chunks.spans(data, offsets, lead)
        of, head = _chunks.different(data, begin, end)
        raw = data.tobytes()
        own = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        assert [own[head[k]] for k in of.tolist()] == own and len(set(own)) == len(head)
        for i, text in enumerate(texts):
            part = own[first[i] : first[i + 1]]
            assert b"".join(part) == text.encode() if lead else part == text.encode().split()


def test_latent_space_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(4)
    names = [f"w{k}" for k in range(20)]
    texts = [" ".join(rng.choice(names, 90)) for _ in range(30)]
    vocabulary = np.unique(decontaminate._hashes(" ".join(names)))
    codes = docs(spark, list(enumerate(texts))).select("doc_id", "text").mapInArrow(decontaminate._encode(spark.sparkContext.broadcast(vocabulary)), decontaminate._CODES).cache()
    column = np.arange(-1, 20, dtype=np.int32)
    idf, bench = rng.uniform(1, 3, 20), rng.uniform(0, 2, (30, 20))
    vectors, values = decontaminate.latent_space(codes, False, column, idf, bench)
    units = np.concatenate([np.frombuffer(r.codes, np.uint16).reshape(-1, decontaminate.UNIT) for r in codes.collect()])
    dense = np.stack([np.bincount(u, minlength=21)[1:] for u in units]) * idf
    want = np.linalg.svd(np.concatenate([dense, bench]), full_matrices=False)
    assert np.allclose(values, want[1], rtol=1e-3)
    assert np.allclose(np.abs((vectors * want[2].T).sum(0))[:3], 1, atol=1e-2)


def test_toxicity_on_held_out_labels(spark):
    sf = DATA.replace("0.001", "0.1")
    labels, table = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    toxic = F.col("toxic") == 1
    chain = toxicity.train(table, labels.where("doc_id % 4 <> 0"), {"toxic": toxic, "toxic_good": toxic & (F.col("quality") == 1)})
    held = chain.score(table).join(labels.where("doc_id % 4 = 0"), "doc_id")
    for name, real in (("toxic", toxic), ("toxic_good", toxic & (F.col("quality") == 1))):
        said = F.col(f"p_{name}") >= 0.5
        hit, found, there = held.agg(F.count_if(said & real), F.count_if(said), F.count_if(real)).first()
        assert hit >= 0.75 * there and hit >= 0.85 * found


def test_stages_take_awkward_and_empty_tables(spark):
    import corpus_pipeline

    clean = " ".join(f"the {k} and of word{k * 7 % 13}" for k in range(30))
    rows = [*awkward(), (20, clean), (None, clean + " end")]
    own = {"key": F.concat(F.lit("user-"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")), "n_removed": F.lit(77), "row_key": F.lit("mine"), "Cut_Words": F.lit(5), "component": F.lit("c"), "no_text": F.lit(1), "c0": F.lit(2)}
    table = docs(spark, rows).withColumns(own)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, table, DATA)
        assert out.columns == table.columns, name
        kept = out.collect()
        assert kept and all(r.key == f"user-{-1 if r.doc_id is None else r.doc_id}" and (r.n_removed, r.row_key, r.Cut_Words, r.component, r.no_text, r.c0) == (77, "mine", 5, "c", 1, 2) for r in kept), name
        assert stage(spark, table.limit(0), DATA).count() == 0, name
    kept = corpus_pipeline.near_duplicate(spark, table, DATA).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id and r.doc_id > 3) == [4, 5, 7, 9, 20]  # 10 shares 11 of 13 shingles with 5
    assert len(corpus_pipeline.encode(spark, table.limit(0), DATA).collect()) == 0


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Session:
        conf = type("C", (), {"get": lambda self, k, d=None: d})()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        _shared.shared_dir(Session())


def test_near_dedup_stage_links_by_fingerprints_first(spark, monkeypatch):
    """SimHash finds what differs by little, the exact check drops what it links wrongly, the index adds the rest."""
    import corpus_pipeline

    seen = []
    found = simhash_dedup.candidates

    def watched(prints):
        pairs = found(prints)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(simhash_dedup, "candidates", watched)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "end"]), " ".join([*base[:200], "x", "y", "z", *base[203:]]), "quite another text of a few words", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = corpus_pipeline.near_duplicate(spark, docs, "").collect()
    assert sorted(r.doc_id for r in left) == [0, 3, 4] and seen and seen[0] >= 1
