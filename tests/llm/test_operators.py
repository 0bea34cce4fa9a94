"""The training-data operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import functools
import random
import unicodedata

import numpy as np
import pytest

from ostraka.storage import Scratch
from ostraka.llm import components, encode, leaks, overlap, residue, spans, splits


def _union(pairs, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# --- p1 ------------------------------------------------------------------------------------


def _covered(records, length):
    seen = {}
    for k, t in records.items():
        for i in range(len(t) - length + 1):
            seen.setdefault(tuple(t[i:i + length]), set()).add(k)
    out = set()
    for k, t in records.items():
        on = [False] * len(t)
        for i in range(len(t) - length + 1):
            if len(seen[tuple(t[i:i + length])]) > 1:
                on[i:i + length] = [True] * length
        i = 0
        while i < len(t):
            if on[i]:
                j = i
                while j + 1 < len(t) and on[j + 1]:
                    j += 1
                out.add((k, i, j))
                i = j
            i += 1
    return out


def test_shared_spans_match_brute_force(spark):
    rng = random.Random(3)
    records = {f"r{k}": [rng.choice("abc") for _ in range(rng.randint(0, 40))] for k in range(40)}
    df = spark.createDataFrame([(k, t, "x") for k, t in records.items()], "fragment_id string, tokens array<string>, pos string")
    got = {tuple(r) for r in spans.shared_spans(df, length=5).collect()}
    assert got == _covered(records, 5)
    share = {r.fragment_id: r.shared_tokens for r in spans.shared_fraction(df, length=5).collect()}
    assert share == {k: sum(e - s + 1 for f, s, e in got if f == k) for k in records}


def test_spans_edge_cases(spark):
    long = " ".join(f"t{i}" for i in range(20))
    rows = [("a", "b", long, long + " end"), ("a", None, "  " + long.replace(" ", "\t"), None), ("c", "d", None, ""), (None, "e", long, "x y")]
    df = spark.createDataFrame(rows, "query_id string, predicted string, query_rendering string, predicted_rendering string")
    frags = spans.renderings(df)
    assert {r.fragment_id for r in frags.collect()} == {"a", "b", "e"}
    assert {tuple(r) for r in spans.shared_spans(frags).collect()} == {("a", 0, 19), ("b", 0, 19)}
    assert spans.shared_spans(frags.limit(0)).count() == 0
    one = spark.createDataFrame([("a", ["x"] * 60)], "fragment_id string, tokens array<string>")
    assert spans.shared_spans(one).count() == 0  # a repetition within one record is not shared
    assert spans.later_occurrences(one).count() == 1
    kept = spans.later_occurrences(frags).collect()
    assert [tuple(r) for r in kept] == [("b", 0, 19)]


# --- p2 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [0, 1])
def test_groups_match_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"v{rng.randint(0, 150)}", f"v{rng.randint(0, 150)}") for _ in range(90)]
    pairs += [(f"c{i}", f"c{i + 1}") for i in range(60)]  # a chain
    pairs += [("hub", f"h{i}") for i in range(60)]  # a star
    rows = [(a, b, 1) for a, b in pairs] + [(" v1 ", None, 2), (None, "alone", 2), (None, None, 2), ("", "v2", 3), pairs[0] + (4,)]
    df = spark.createDataFrame(rows, "fragment_id_a string, fragment_id_b string, group_id int")
    got = [tuple(r) for r in components.group_ids(df, "fragment_id_a", "fragment_id_b").collect()]
    ids = {x for p in pairs for x in p} | {"v1", "v2", "alone"}
    assert len(got) == len(dict(got)) and dict(got) == _union(pairs, ids)


def test_groups_of_nothing(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert components.group_ids(df, "a", "b").count() == 0
    lone = spark.createDataFrame([("x", None), ("y", "y")], "a string, b string")
    assert {tuple(r) for r in components.group_ids(lone, "a", "b").collect()} == {("x", "x"), ("y", "y")}


def test_equal_labels_of_two_rounds_stay_apart(spark, monkeypatch, tmp_path):
    # names that only shift: the chain 1-2-3-4 ends in round 2 under 43, the pair 43-44 in round 0 under 43
    monkeypatch.setattr(components, "_mix", lambda seed, c: c + 14 * seed)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (43, 44)], "a long, b long")
    got = {r.v: (r.round, r.label) for r in components.contract(edges, Scratch(spark, "t"), 0).collect()}
    assert {v: x[1] for v, x in got.items()} == {v: 43 for v in (1, 2, 3, 4, 43, 44)}
    assert len({got[v] for v in (1, 2, 3, 4)}) == 1 and len({got[v] for v in (43, 44)}) == 1 and got[1] != got[43]


def test_names_that_collide_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(components, "_name", lambda seed, c: components.F.pmod(components.F.xxhash64(c), components.F.lit(4)))
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(20)] + [("p", "q"), ("r", None)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = dict(tuple(r) for r in components.group_ids(df, "a", "b").collect())
    assert got == _union([p for p in pairs if p[1]], {x for p in pairs for x in p if x})


# --- p3 ------------------------------------------------------------------------------------

_SPLITS = "doc_id string, cth int, site string, is_bin boolean, main_split string"


def test_divided_compositions(spark):
    rows = [
        ("d1", 1, "s", False, "train"), ("d1", 2, "s", False, " DEV "),  # a shared tablet joins 1 and 2
        ("d2", 2, "s", None, None), ("d3", 3, "s", False, "train"), ("d3", 3, "s", False, "Train"),
        ("d4", 9, "s", True, "discovery"), ("d5", 9, "s", False, "test"),  # a bin with a labelled row
        ("d6", 8, "s", True, "discovery"), ("d1", 8, "s", True, None),  # bins link nothing
        ("d7", None, "s", False, "test"), (None, 4, "s", False, "dev"), (None, 4, "s", False, "test"),
    ]
    df = spark.createDataFrame(rows, _SPLITS)
    assert {r.cth for r in splits.divided(df).collect()} == {1, 2, 9, 4}
    assert splits.divided(df.limit(0)).count() == 0


def test_assignment_keeps_groups_and_proportions(spark):
    rng = random.Random(5)
    rows = [(f"d{i}", rng.randint(1, 300), rng.choice("abc"), False, "train") for i in range(1500)]
    rows += [(f"d{i}", 500 + i % 5, "a", True, "discovery") for i in range(2000, 2100)] + [("only", None, None, None, None), (None, 7, None, None, None), rows[0]]
    out = splits.assign(spark.createDataFrame(rows, _SPLITS)).collect()
    by_cth, by_doc = {}, {}
    for r in out:
        if r.cth is not None:
            by_cth.setdefault(r.cth, set()).add(r.split)
        if r.doc_id is not None and r.split != "discovery":
            by_doc.setdefault(r.doc_id, set()).add(r.split)
    assert all(len(v) == 1 for v in by_cth.values()) and all(len(v) == 1 for v in by_doc.values())
    assert all(by_cth[500 + i] == {"discovery"} for i in range(5))
    count = {s: sum(v == {s} for v in by_doc.values()) / len(by_doc) for s in splits.SPLITS}
    # documents join 300 compositions at random only once, so groups stay small and the proportions can be met
    assert abs(count["train"] - 0.8) < 0.02 and abs(count["dev"] - 0.1) < 0.02
    assert splits.assign(spark.createDataFrame([], _SPLITS)).count() == 0


def test_rare_sites_are_balanced_together(spark, monkeypatch):
    monkeypatch.setattr(splits, "MAX_LABELS", 2)
    rng = random.Random(6)
    rows = [(f"d{i}", i // 5, rng.choice(["a", "b"]) if i % 2 else f"rare{i % 40}", False, None) for i in range(1200)]
    df = spark.createDataFrame(rows, _SPLITS)
    out = {r.doc_id: r.split for r in splits.assign(df).collect()}
    rare = [out[r[0]] for r in rows if r[2].startswith("rare")]
    assert abs(rare.count("train") / len(rare) - 0.8) < 0.02 and abs(rare.count("test") / len(rare) - 0.1) < 0.02


def test_balance_sees_what_is_wrong(spark):
    rows = [("d1", 1, "s", False, None), ("d1", 2, "s", False, None), ("d2", 9, "s", True, None), ("d3", 3, "s", False, None)]
    df = spark.createDataFrame(rows, _SPLITS)
    bad = spark.createDataFrame([("d1", 1, "train"), ("d1", 2, "dev"), ("d2", 9, "train"), ("d3", 3, "train")], "doc_id string, cth int, split string")
    r = splits.balance(df, bad).first()
    assert (r.rows, r.divided, r.misplaced, r.balanced) == (4, 1, 1, False)


# --- p5 ------------------------------------------------------------------------------------


def _edit(a, b):
    """Least number of changes, straight from the definition."""

    @functools.cache
    def left(i, j):
        if i == len(a) or j == len(b):
            return len(a) - i + len(b) - j
        if a[i] == b[j]:
            return left(i + 1, j + 1)
        return 1 + min(left(i + 1, j), left(i, j + 1), left(i + 1, j + 1))

    return left(0, 0)


def test_edit_limit_matches_the_table():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        d = _edit(a, b)
        for k in (d - 1, d, d + 1):
            if k >= 0:
                assert overlap.within_edits(a, b, k) == (d <= k)


def test_cross_split_pairs_match_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    texts, labels = {}, {}
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(14, 50))]
        for j in range(3):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts[f"t{i}_{j}"] = t
            labels[f"t{i}_{j}"] = rng.choice(["train", " Dev", "TEST ", "discovery"])
    rows = [(d, " ".join(t)) for d, t in texts.items()] + [("t0_0", None), (None, "x"), ("short", "a b c"), ("t1_0", " [" + " ".join(texts["t1_0"]) + "]? ")]
    log = spark.createDataFrame([(*r, "z") for r in rows], "doc_id string, query_rendering string, side string")
    two = [("t2_0", "train"), ("t2_0", "dev")]
    tab = spark.createDataFrame([*labels.items(), *two, ("t3_0", None)], "doc_id string, main_split string")
    side = {d: s.strip().lower() for d, s in labels.items()}
    side.pop("t2_0")  # several labels
    want = set()
    for a, s in side.items():
        for b, u in side.items():
            if s == "train" and u in ("dev", "test") and _edit(texts[a], texts[b]) <= int(0.2 * max(len(texts[a]), len(texts[b]))):
                want.add((a, b))
    got = [tuple(r) for r in overlap.cross_split_pairs(log, tab).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(got) >= 0.95 * len(want) and want
    assert overlap.cross_split_pairs(log.limit(0), tab).count() == 0
    sure = [tuple(r) for r in overlap.cross_split_pairs(log, tab, exact=True).collect()]
    assert len(sure) == len(set(sure)) and set(sure) == want
    assert overlap.cross_split_pairs(log.limit(0), tab, exact=True).count() == 0


def test_pairs_are_counted_as_they_would_be_made(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    base = [[rng.choice(vocab) for _ in range(20)] for _ in range(6)]
    rows, labels = [], []
    for i in range(120):
        side = rng.choice(["train", "train", "dev", "test"])
        labels.append((f"t{i}", side, rng.choice(["S", "T", None])))
        if i % 7 == 0:
            labels.append((f"t{i}", side, "U"))
        for _ in range(rng.choice([1, 1, 2, 3])):
            t = list(rng.choice(base))
            if rng.random() < 0.3:
                t[3] = "other"
            rows.append((f"t{i}", " ".join(t)))
    log = spark.createDataFrame(rows, "doc_id string, query_rendering string")
    tab = spark.createDataFrame([(d, s, m) for d, m, s in labels], "doc_id string, site string, main_split string")
    pairs = overlap.cross_split_pairs(log, tab).collect()
    label = {d: m for d, m, _ in labels}
    sites = {}
    for d, _, s in labels:
        sites.setdefault(d, set()).add(s)
    want = {}
    for r in pairs:
        for s in (sites[r.eval_id] - {None}) or {None}:
            want.setdefault((label[r.eval_id], s), []).append(r.eval_id)
    got = {(r.eval_split, r.site): (r.pairs, r.eval_tablets) for r in overlap.overlap_report(log, tab).collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()} and want
    classes = overlap.linked_classes(log, tab).collect()
    assert {(r.doc_id, r.class_id) for r in classes} and len(classes) == len({(r.doc_id, r.class_id) for r in classes})
    linked = {r.doc_id for r in classes if r.links}
    assert linked == {r.train_id for r in pairs} | {r.eval_id for r in pairs}


@pytest.mark.parametrize("n", range(1, 200))
def test_a_piece_is_left_whole(n):
    cut = overlap.pieces(n, 0.2)
    assert [s for s, _ in cut] == [sum(x for _, x in cut[:i]) for i in range(len(cut))] and sum(x for _, x in cut) == n
    assert len(cut) > int(0.2 * n / 0.8 + 1e-9)
    assert n < 12 or min(x for _, x in cut) >= 3


# --- p6 ------------------------------------------------------------------------------------


def _reference_encoder():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    return lambda ts: [e.ids for e in tok.encode_batch(ts, add_special_tokens=False)]


def test_ids_equal_the_public_library(spark):
    rng = random.Random(4)
    signs = " \n\t\r'stmdrevlaZ9½.-—é  \U00012000́ḫ<|endoftext|>你"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["", " ", "a" * 5000, "don't we'll 's 've", "<|endoftext|>", "x" + " " * 300 + "\n\n y"]
    want = _reference_encoder()(texts)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(-1, None, 0), (0, texts[0], 0)], "doc_id long, text string, ids int")
    rows = encode.token_ids(df).collect()
    assert len(rows) == len(texts) + 2
    assert all(r.ids == (want[r.doc_id] if r.doc_id >= 0 else []) for r in rows)
    assert encode.token_ids(df.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    hashes = np.unique(np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64))
    table = encode.build_perfect_hash(hashes)
    assert sorted(table.slot(hashes).tolist()) == list(range(len(hashes)))


def test_long_pieces_merge_like_the_library():
    v = encode.Vocabulary.load(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken")
    ranks = {e: i for i, e in enumerate(v.entries)}
    for piece in ("abababababab" * 20, "ḫattušili", "aaaaaaa", "zzzzyx"):
        assert encode.merge_bytes(piece.encode(), ranks) == _reference_encoder()([piece])[0]


# --- p7 ------------------------------------------------------------------------------------


def test_leaks_match_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(30)]
    items = [(i, [rng.choice(vocab) for _ in range(rng.randint(5, 90))]) for i in range(60)]
    docs = []
    for d in range(150):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        _, source = rng.choice(items)
        n = rng.randint(15, 26)
        s = rng.randrange(max(1, len(source) - n + 1))
        at = rng.randint(0, len(body))
        docs.append((d, body[:at] + source[s:s + n] + body[at:]))

    def grams(w):
        return {tuple(w[k:k + 20]) for k in range(len(w) - 19)}

    want = {(d, i) for d, w in docs for i, v in items if grams(w) & grams(v)}
    dd = spark.createDataFrame([(d, " [".join(w).upper(), 1) for d, w in docs] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, item_id int")
    ii = spark.createDataFrame([(i, ", ".join(v)) for i, v in items] + [(77, None)], "item_id long, text string")
    for more in ({}, {"shard_words": 300, "piece_words": 100}, {"shard_words": 41, "piece_words": 40}):  # one shard, many, and items in pieces
        got = [tuple(r) for r in leaks.leaks(dd, ii, **more).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    assert leaks.leaks(dd, ii.limit(0)).count() == 0 and leaks.leaks(dd.limit(0), ii).count() == 0


@pytest.mark.parametrize("n", [0, 19, 20, 21, 39, 40, 41, 60, 61, 200])
def test_pieces_hold_every_run(n):
    w = [str(i) for i in range(n)]
    cut = leaks.item_pieces(w, 20, 40)
    runs = {tuple(p[s:s + 20]) for p in cut for s in range(len(p) - 19)}
    assert runs == {tuple(w[s:s + 20]) for s in range(n - 19)} and all(20 <= len(p) <= 40 for p in cut)


def test_words_are_normalised():
    assert leaks.words("Ke[m]-pú ⸢A⸣" + unicodedata.normalize("NFD", "É") + " x_y") == ["kem", "pú", "aé", "x", "y"]


# --- p8 ------------------------------------------------------------------------------------

RESIDUE = [
    "Edited by {{ title }}", "See also [[CTH_NUMBER]]", "Site: ${title}", "Width: <%= summary %>", "{% block date %}{% endblock %}", "Image: {0} / {1}",
    "[INSERT AUTHOR HERE]", "[Insert width] of the tablet", "<insert siglum here>", "(date to be filled in)", "TODO: add museum no", "[siglum einfügen]",
    "Your editor goes here.", "lorem ipsum dolor", "Sample text Sample text Sample text", "bla bla bla bla bla bla bla", "jklö asdf qwer asdf fghj",
    "404 Not Found", "502 Bad Gateway\n\ngateway/1.11", "Traceback (most recent call last):\n  File \"a.py\", line 3, in f", "java.lang.NullPointerException",
    "Sayfa bulunamadı.", "Es ist ein Fehler aufgetreten.", "Erreur 404 : la page demandée n'existe pas.", "Errore interno del server.",
    "Access denied. You don't have permission to access this record.", "Please enable JavaScript to use the edition.", "Bitte aktivieren Sie JavaScript.",
    "<noscript>The viewer will not work</noscript>", "Turn on cookies and JavaScript, then reload this page.", "Your session has expired. Please log in again.",
    "A real commentary on the tablet.\nTest entry 14 please ignore / delete me.",
]
CLEAN = [
    None, "", "  \n", "{d}ḫa-šu {KUR}Pišas <NUM> x x x x x x x [x x x] ⸢lu⸣", "The form $180 in the old notes is a price mark, not a sign.",
    "The joining piece was not found in depot 3, and the entry is left open.", "Server is the title given to cupbearers; 36 of them are named.",
    "Filler words such as nu are 60% of this text.", "The colophon is a template in which only the name was filled in by the scribe.",
    "Access to the room was denied to the envoy for 89 days.", "Wedge script is required for the index; we give only the numbers 215 and 503.",
    "This is a plain scribal error: a for b, as in line 404 of the composite.", "The set {w, nu, h} is complete after 12 lines; see page 404.",
    "In this tutorial the template syntax is explained: for example `{{ name }}` is replaced by the value of the variable when the page of the edition is rendered for the reader.",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_found(text):
    assert residue.residue_kind(text)
    assert residue.residue_kind("A seal of Pišas was copied in room 3.\n" + text + "\nThe list names two scribes.")


@pytest.mark.parametrize("text", CLEAN)
def test_real_content_is_kept(text):
    assert residue.residue_kind(text) is None


def test_residue_over_a_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(RESIDUE + CLEAN)] + [(0, RESIDUE[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted(r.doc_id for r in residue.residue(df).collect())
    assert got == sorted([*range(len(RESIDUE)), 0])
    assert residue.residue(df.limit(0)).count() == 0
    assert residue.residue_kind("word " * 200_000 + "{{ x }}")  # whole texts, however long
