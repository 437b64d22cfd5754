"""Similarity joins, passages, decontamination, toxicity and the pipeline against brute force."""

import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from oracle import SF, assert_same

from apexframe.llm import common, compact_windows, components, decontaminate, parity_join, queries, toxicity
from apexframe.llm.common import word_hashes
from apexframe.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None), (-1, ""), (-2, " \n\t"), (-3, "one"), (-4, "one"), (-5, "ONE"), (-6, "one two"), (None, "null id text that is long enough to have shingles")]


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed=0, n=120, edits=(0, 1, 2, 3, 5, 9)):
    """Texts of 5 to 400 words, each with copies in which some words differ."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(n // 4):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 12, 40, 90, 200, 400]))]
        for _ in range(4):
            t = list(base)
            for _ in range(rng.choice(edits)):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], ["Edited"], [t[k], "more"], [rng.choice(vocab)]])
            rows.append((len(rows), " ".join(t)))
    return rows


def classes(links, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, size):
    w = words_of(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def test_word_kernel_equals_the_pattern():
    rng = random.Random(3)
    texts = [None, "", "A b c d\x1ce\x85f", "É é ß\nIİ"] + ["".join(rng.choice("aAbé \n\t\x0b\x00€") for _ in range(rng.randrange(60))) for _ in range(300)]
    column = pa.array(["pad", *texts], pa.string())[1:]
    hashes, first = word_hashes(column)
    named: dict = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        assert first[i + 1] - first[i] == len(w)
        for x, h in zip(w, hashes[first[i] : first[i + 1]].tolist(), strict=True):
            assert named.setdefault(x, h) == h
    assert len(set(named.values())) == len(named)


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100), **dict.fromkeys((200, 201, 202), 200)}


def test_a_round_of_components_takes_three_shuffles(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "a long, b long")
    plan = components._small_star(components._large_star(edges))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_further_links_join_components(spark):
    rng = random.Random(19)
    first, more = ([(rng.randrange(200), rng.randrange(200)) for _ in range(60)] for _ in range(2))
    frames = [spark.createDataFrame(x, "a long, b long") for x in (first, more)]
    joined = parity_join._joined(connected_components(frames[0]), frames[1])
    assert sorted(joined.collect()) == sorted(connected_components(frames[0].unionByName(frames[1])).collect())


def test_bands_never_miss_a_pair_of_blocks():
    rng = np.random.default_rng(0)
    for num, den in ((85, 100), (80, 100)):
        bands = parity_join.Bands(num, den)
        for _ in range(400):
            n = int(rng.integers(2, 300))
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            n = len(a)
            keep = int(rng.integers(int(0.75 * n), n + 1))
            b = np.unique(np.concatenate((a[:keep], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if den * both < num * (len(a) + len(b) - both) or len(a) == len(b) == both:
                continue
            keys = [np.concatenate([parity_join.block_keys(s, k, bands) for k in bands.of(len(s))]) for s in (a, b)]
            assert len(np.intersect1d(*keys)), (n, len(b), both)


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80)])
def test_similarity_classes_by_brute_force(docs, size, num):
    rows = corpus(size) + ODD
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = classes(links, sets)
    out = parity_join.similarity_classes(docs(rows), size, num, 100).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == want
    assert {r["doc_id"]: r["n_shingles"] for r in out if r["doc_id"] is not None} == {i: len(s) for i, s in sets.items()}
    assert len(set(want.values())) < len(want)


def test_similarity_of_no_rows(docs):
    assert parity_join.similarity_classes(docs([])).count() == 0


def test_op8_sql(spark, docs):
    docs([])
    assert_same(spark, SF, queries.queries()["op8_parity_sketch_join"], queries.oracle_sql()["op8_parity_sketch_join"])


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for n, width in ((0, 5), (4, 5), (60, 5), (300, 46), (2000, 46)):
        v = compact_windows.mix64(rng.integers(0, 40 if n < 100 else 1 << 40, n).astype(np.uint64))
        order = [(int(x) >> 22, i) for i, x in enumerate(v)]
        want, todo = set(), [(0, n - 1)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo + 1 >= width:
                c = min(range(lo, hi + 1), key=order.__getitem__)
                want.add((lo, c, hi))
                todo += [(lo, c - 1), (c + 1, hi)]
        got = compact_windows.compact_windows(v, np.array([0, n]), width)
        assert set(zip(*(x.tolist() for x in got), strict=True)) == want
        cuts = np.array([0, 0, n // 3, n // 3 + min(n // 3, width), n, n])
        parts = [[x + lo for x in compact_windows.compact_windows(v[lo:hi], np.array([0, hi - lo]), width)] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        got = compact_windows.compact_windows(v, cuts, width)
        assert all((g == np.concatenate(p)).all() for g, p in zip(got, zip(*parts, strict=True), strict=True))


def test_passages_by_construction(docs):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(5000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    p, q, near = text(60), text(51), None
    near = [*p[:30], "changed", *p[31:]]
    rows = [(0, text(80) + p + text(30)), (1, text(10) + p + text(300)), (2, p), (3, text(200) + near), (4, q + text(20)), (5, text(70) + q), (6, text(500)), (7, text(40)), (8, text(100) + p[:40] + text(100)), (9, text(49))]
    rows = [(i, " ".join(t)) for i, t in rows] + [(10, rows_9 := " ".join(text(55))), (11, rows_9), (12, None), (13, ""), (None, None)]
    out = {r["doc_id"]: r for r in compact_windows.passage_classes(docs(rows)).collect()}
    assert len(out) == len(rows)
    assert [out[i]["component_id"] for i in range(14)] == [0, 0, 0, 0, 4, 4, 6, 7, 8, 9, 10, 10, 12, 13]
    inside = lambda i, a, b: any(s["start_word"] <= a and s["end_word"] >= b for s in out[i]["spans"])
    assert inside(0, 80, 140) and inside(1, 10, 70) and inside(2, 0, 60) and inside(3, 200, 260) and inside(4, 0, 51) and inside(5, 70, 121) and inside(11, 0, 55)
    assert all(not out[i]["spans"] for i in (6, 7, 8, 9, 12, 13)) and out[0]["repeated_words"] < 75
    assert compact_windows.passage_classes(docs([])).count() == 0


def test_a_passage_in_many_documents_is_one_class(docs):
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(70)]
    rows = [(i, " ".join([f"x{rng.randrange(9999)}" for _ in range(60)] + shared + [f"y{rng.randrange(9999)}" for _ in range(60)])) for i in range(150)]
    out = compact_windows.passage_classes(docs(rows)).collect()
    assert {r["component_id"] for r in out} == {0} and all(r["repeated_words"] >= 70 for r in out)


def test_exact_passages_of_frequent_lines(docs):
    rng = random.Random(11)
    word = lambda: f"z{rng.randrange(90_000)}"
    rows, pairs = [], []
    for _ in range(6):
        lines = [[word() for _ in range(12)] for _ in range(5)]
        pairs.append((len(rows), len(rows) + 1))
        rows += [[word() for _ in range(70)] + sum(lines, []) + [word() for _ in range(70)] for _ in range(2)]
        rows += [[word() for _ in range(60)] + rng.choice(lines) + [word() for _ in range(60)] for _ in range(300)]
    out = {r["doc_id"]: r for r in compact_windows.passage_classes(docs([(i, " ".join(t)) for i, t in enumerate(rows)])).collect()}
    inside = lambda r: any(s["start_word"] <= 70 and s["end_word"] >= 130 for s in r["spans"])
    assert [out[b]["component_id"] for _, b in pairs] == [a for a, _ in pairs]
    assert all(inside(out[i]) and out[i]["links"] == 1 for p in pairs for i in p)
    assert all(r["component_id"] == i and not r["spans"] and not r["links"] for i, r in out.items() if i not in sum(pairs, ()))


def test_near_passages_of_frequent_lines(docs):
    """A passage of five lines with one word changed (similarity 0.84); each line stands in 40 other texts."""
    rng = random.Random(13)
    word = lambda: f"z{rng.randrange(90_000)}"
    rows, pairs = [], []
    for _ in range(25):
        lines = [[word() for _ in range(12)] for _ in range(5)]
        passage = sum(lines, [])
        changed = list(passage)
        changed[rng.randrange(24, 36)] = "changed"
        pair = [[word() for _ in range(70)] + p + [word() for _ in range(70)] for p in (passage, changed)]
        others = [[word() for _ in range(60)] + line + [word() for _ in range(60)] for line in lines for _ in range(40)]
        group = pair + others
        rng.shuffle(group)
        pairs.append(tuple(len(rows) + group.index(p) for p in pair))
        rows += group
    out = {r["doc_id"]: r for r in compact_windows.passage_classes(docs([(i, " ".join(t)) for i, t in enumerate(rows)])).collect()}
    found = sum(out[a]["component_id"] == out[b]["component_id"] for a, b in pairs)
    assert found >= 23
    assert all(r["links"] <= 1 for r in out.values()) and sum(r["links"] for r in out.values()) == 2 * found


def test_a_text_between_two_passages_keeps_both(docs):
    rng = random.Random(12)
    text = lambda n: [f"y{rng.randrange(90_000)}" for _ in range(n)]
    p, q, r = text(60), text(60), text(60)
    rows = [text(20) + p + text(30) + q, text(30) + q + text(20) + r, text(10) + r + text(40) + p]
    out = sorted(compact_windows.passage_classes(docs([(i, " ".join(t)) for i, t in enumerate(rows)])).collect())
    assert [x["component_id"] for x in out] == [0, 0, 0] and [x["links"] for x in out] == [2, 2, 2]
    assert [[tuple(s) for s in x["spans"]] for x in out] == [[(20, 80), (110, 170)], [(30, 90), (110, 170)], [(10, 70), (110, 170)]]


def best_windows(text, items):
    """By brute force: item to best weighted Jaccard of a window of its length."""
    w = words_of(text)
    s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    out = {}
    for i, t in items:
        iw = words_of(t)
        c = Counter([tuple(iw[k : k + 5]) for k in range(len(iw) - 4)] or ([tuple(iw)] if iw else []))
        n = sum(c.values())
        if n and s and set(c) & set(s):
            sims = []
            for k in range(max(1, len(s) - n + 1)):
                x = Counter(s[k : k + n])
                sims.append(sum((x & c).values()) / sum((x | c).values()))
            if max(sims) >= 0.8:
                out[i] = max(sims)
    return out


def test_leaks_by_brute_force(spark, docs):
    rng = random.Random(2)
    vocab = [f"b{i}" for i in range(2000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(15, 60)))) for i in range(30)] + [(90, "few words"), (91, None), (92, ""), (93, "again again again again again again again again")]
    rows = []
    for i, t in items[:30]:
        w = t.split()
        rows += [(100 + i, " ".join(text(rng.randrange(200)) + w + text(40))), (200 + i, " ".join([*w[:-1], *text(30)])), (300 + i, " ".join(w[: len(w) // 2] + text(50))), (400 + i, " ".join([*text(9), *w[:20], "edit", *w[20:]]).upper())]
    rows += [(1, "few words"), (2, "few Words more"), (3, None), (4, ""), (5, "again " * 12), (6, " ".join(text(3000)) + " " + items[3][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs(rows), table).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found}
    want = {(d, i): s for d, t in rows for i, s in best_windows(t, items).items()}
    assert set(got) <= set(want) and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
    exact = {k for k, s in want.items() if s == 1}
    assert exact <= set(got) and len(got) >= 0.95 * len(want)
    kept = decontaminate.drop_leaking(docs(rows), table)
    assert kept.columns == docs(rows).columns and kept.count() == len(rows) - len({d for d, _ in got})
    assert decontaminate.find_leaks(docs([]), table).count() == 0 and decontaminate.find_leaks(docs(rows), table.limit(0)).count() == 0


def test_leaking_rows_go_by_their_own_text(spark, docs):
    item = " ".join(f"i{k}" for k in range(40))
    rows = [(None, item), (None, "clean text of a row without an id"), (7, "before " + item), (7, "another text under the same id"), (None, None), (8, "")]
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.drop_leaking(docs(rows), table)
    assert kept.schema == docs(rows).schema
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in kept.collect()])) == sorted(map(str, [rows[1], rows[3], rows[4], rows[5]]))
    assert decontaminate.drop_leaking(docs(rows), table.limit(0)).count() == len(rows)


def test_near_copies_are_complete():
    rng = random.Random(14)
    word = lambda: f"q{rng.randrange(90_000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(49, 60)))) for i in range(60)]
    rows = []
    for i, t in items * 4:
        w = t.split()
        w[rng.randrange(20, 30)] = word()
        rows.append((len(rows), " ".join([*(word() for _ in range(rng.randrange(80))), *w, *(word() for _ in range(rng.randrange(80)))])))
    rows += [(1000, " ".join(items[0][1].split()[2:])), (1001, "again " * 30), (1002, items[1][1] + " x " + items[1][1])]
    items.append((99, "again again again again again again again again"))
    shingles_, start = decontaminate.shingle_runs(pa.array([t for _, t in rows]), 5)
    classes_ = decontaminate.item_classes(items)
    got = {(rows[d][0], classes_[c].items[i][0]): x for (d, c, i), x in decontaminate.leaks_in(shingles_, start, classes_).items()}
    want = {(d, i): s for d, t in rows for i, s in best_windows(t, items).items()}
    assert {k: x[0] for k, x in got.items()} == pytest.approx(want) and len(want) >= 240
    assert got[1002, 1][1] == 0


def test_overlaps_of_all_windows_by_counting():
    rng = random.Random(15)
    for _ in range(60):
        shingles_ = np.array([rng.randrange(12) for _ in range(rng.randrange(1, 60))], np.uint64)
        item = np.array([rng.randrange(12) for _ in range(rng.randrange(1, 20))], np.uint64)
        size = rng.randrange(1, len(shingles_) + 1)
        first = rng.randrange(len(shingles_) - size + 1)
        last = rng.randrange(first, len(shingles_) - size + 1)
        values, counts = np.unique(item, return_counts=True)
        got = decontaminate.overlaps(shingles_, first, last, size, values, counts)
        want = [sum((Counter(shingles_[s : s + size].tolist()) & Counter(item.tolist())).values()) for s in range(first, last + 1)]
        assert got.tolist() == want


def test_simhashes_of_windows_longer_than_a_segment():
    rng = np.random.default_rng(16)
    shingles_ = rng.integers(0, 1 << 63, 3 * decontaminate.SEGMENT + 77).astype(np.uint64)
    starts = np.array([0, 5, 9, decontaminate.SEGMENT, 2 * decontaminate.SEGMENT + 3])
    ends = np.array([len(shingles_), 12, decontaminate.SEGMENT + 9, 3 * decontaminate.SEGMENT, len(shingles_)])
    got = decontaminate.simhashes(shingles_, [(starts, ends), (starts[:0], ends[:0])])
    for p, a, b in zip(got[0], starts, ends, strict=True):
        ones = np.unpackbits(shingles_[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        assert int(p) == sum(1 << k for k in range(64) if ones[k] > (b - a) // 2)
    assert len(got[1]) == 0


def test_items_of_any_length_and_number_in_one_pass(spark, docs):
    rng = random.Random(17)
    word = lambda: f"m{rng.randrange(900_000)}"
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5000)]
    long = [word() for _ in range(650_000)]
    items += [(5000, " ".join(long)), (7, items[7][1]), (None, items[8][1])]
    assert len(items[5000][1]) > 4 << 20
    edited = [w if k % 400 else "edit" for k, w in enumerate(long)]
    rows = [(i, " ".join([word(), *items[i][1].split(), word()])) for i in range(0, 5000, 50)] + [(7, items[7][1]), (8, items[8][1])]
    rows += [(9001, " ".join([*(word() for _ in range(3000)), *edited, *(word() for _ in range(3000))])), (9002, " ".join(long[:400_000])), (9003, "clean text of some words that no item holds")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    leaks = decontaminate.find_leaks(docs(rows), benchmark)
    plan = leaks._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1 and "Exchange" not in plan
    got = Counter((r["doc_id"], r["item_id"]) for r in leaks.collect())
    want = Counter({(i, i): 1 for i in range(0, 5000, 50)}) + Counter({(7, 7): 2, (8, 8): 1, (8, None): 1, (9001, 5000): 1})
    assert got == want
    kept = decontaminate.drop_leaking(docs(rows), benchmark)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [9002, 9003]


def test_index_finds_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(4)
    items = rng.integers(0, 1 << 63, 70).astype(np.uint64) * np.uint64(2)
    cls = decontaminate.ItemClass(20, [None] * 70, items)
    prints = []
    for p in np.repeat(items, 40):
        flips = rng.choice(64, int(rng.integers(0, 25)), replace=False)
        prints.append(p ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0)))
    prints = np.array(prints, np.uint64)
    got = set(zip(*(x.tolist() for x in cls.candidates(prints)), strict=True))
    want = {(w, i) for w, p in enumerate(prints) for i, q in enumerate(items) if int(p ^ q).bit_count() <= decontaminate.RADIUS}
    assert got == want


def test_windows_cover_every_word():
    n = np.array([0, 1, 63, 64, 65, 112, 113, 1000])
    start, size, first = toxicity.windows_of(np.concatenate(([0], np.cumsum(n))))
    begins = np.concatenate(([0], np.cumsum(n)))
    for i, k in enumerate(n):
        lo, hi = first[i], first[i + 1] if i + 1 < len(n) else len(start)
        covered = {w - begins[i] for s, z in zip(start[lo:hi], size[lo:hi], strict=True) for w in range(s, s + z)}
        assert covered == set(range(k)) and hi > lo


def test_every_byte_of_long_words_is_read():
    rng = random.Random(13)
    long = "".join(rng.choice("abcdefghij") for _ in range(1000))
    for text in (long, "漢字仮名" * 90, "-".join(["some"] * 60), "x" * 65, "a b " + long + " c"):
        raw = text.encode()
        words = toxicity.Words(pa.array(["before", text, "after " + long[:64]]))
        own = np.unique(words.ids[words.first[1] : words.first[2]])
        seen = {bytes(words.data[words.starts[i] : words.ends[i]][k : k + 5]) for i in own for k in range(60)}
        assert {raw[k : k + 5] for w in text.split(" ") for k in range(raw.index(w.encode()), raw.index(w.encode()) + len(w.encode()) - 4)} <= seen
        rows, _ = words.char_rows(0, len(words))
        assert len(rows) == sum(int(e - s) + 3 - n for s, e in zip(words.starts, words.ends, strict=True) for n in toxicity.NGRAMS if e - s + 2 >= n)
    net = toxicity.new_network()
    a, b = toxicity.score_texts(net, pa.array([long, long[:900] + "idiot" + long[905:]]))
    parts = toxicity.Words(pa.array([long, long[:900] + "idiot" + long[905:]]))
    both = [set(parts.ids[parts.first[i] : parts.first[i + 1]].tolist()) for i in (0, 1)]
    assert a != b and len(both[0] & both[1]) >= 18 and both[0] != both[1]


def test_gradients():
    net = {k: v.astype(np.float64) for k, v in toxicity.new_network().items()}
    words = toxicity.Words(pa.array(["bad words here " * 3, "a fine text " * 30, ""]))
    start, size, _ = toxicity.windows_of(words.first)
    x = toxicity.embed(net, words)[0]
    at = np.arange(int(size.max()))
    ids = np.where(at < size[:, None], words.ids[np.minimum(start[:, None] + at, len(words.ids) - 1)], len(words))
    y = np.arange(len(start)) % 2
    loss = lambda: float(np.sum(np.log1p(np.exp(z := toxicity.forward(net, toxicity._gates(net, x), ids, size))) - y * z))
    tape: dict = {}
    logit = toxicity.forward(net, toxicity._gates(net, x), ids, size, tape)
    grads, by_word = toxicity.backward(net, ids, len(words), tape, (1 / (1 + np.exp(-logit)) - y).astype(np.float32))
    grads["in"] = x.T @ by_word
    for name in ("forth", "back", "attend", "out", "in"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old, eps = net[name][at], 1e-3
        net[name][at] = old + eps
        up = loss()
        net[name][at] = old - eps
        down = loss()
        net[name][at] = old
        assert (up - down) / (2 * eps) == pytest.approx(grads[name][at], rel=0.05, abs=1e-6)


def test_toxicity_on_held_out_documents(spark, docs):
    rng = random.Random(6)
    plain = [f"{a}{b}" for a in ("the", "on", "er", "st", "in", "re") for b in ("a", "ed", "ing", "tion", "ly", "ou", "nd")]
    rows, labels = [], []
    for i in range(700):
        w = [rng.choice(plain) for _ in range(rng.randrange(10, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "lowei" + rng.choice(plain)]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    odd = [(1000, None), (1001, ""), (None, "the ed"), (1002, "tion " * 20_000), (3, rows[3][1])]
    table = spark.createDataFrame(labels + [(None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    net = toxicity.fit(docs(rows + odd), table)
    out = toxicity.score(docs(rows + odd), net).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    truth = dict(labels)
    held = [r for r in out if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum((r["score"] >= 0.3) == truth[r["doc_id"]] for r in held)
    assert len(held) > 120 and right / len(held) >= 0.95
    none = toxicity.fit(docs(rows), table.limit(0))
    assert {r["score"] for r in toxicity.score(docs(rows[:5]), none).collect()} == {1e-6}
    assert toxicity.score(docs([]), net).count() == 0
    assert toxicity.drop_toxic(docs(rows), table).columns == docs(rows).columns


def test_pipeline_by_brute_force(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    docs([])
    data = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    texts = {r["doc_id"]: r for r in data.collect()}
    clean = stages["toxicity"](spark, data, SF)
    assert clean.columns == data.columns
    single = stages["ngram_jaccard_join"](spark, clean, SF)
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in clean.collect()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    kept = {r["doc_id"] for r in single.collect()}
    assert kept == set(classes(links, sets).values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fair = {r["doc_id"] for r in stages["benchmark_decontamination"](spark, single, SF).collect()}
    leaking = {d: max(s.values()) for d in kept if (s := best_windows(texts[d]["text"], items))}
    assert fair | set(leaking) == kept and {d for d, s in leaking.items() if s == 1}.isdisjoint(fair)
    mixed = stages["mixing_sources"](spark, data.where(data.doc_id.isin(list(fair))), SF)
    assert mixed.columns == data.columns and set(Counter(r["doc_id"] for r in mixed.collect()).values()) <= {1, 2, 3}
    out = pipeline.run(spark, SF).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(pipeline.SHARDS)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["doc_id"] for r in out} <= fair


def test_copies_go_by_rows(spark, docs):
    import corpus_pipeline as pipeline

    rng = random.Random(19)
    text = lambda: " ".join(f"r{rng.randrange(99_999)}" for _ in range(60))
    one, two, three, four = text(), text(), text(), text()
    rows = [(1, one), (None, one), (None, two), (5, one), (5, three), (7, four), (7, four), (6, four + " end"), (None, None), (None, ""), (9, "short"), (9, "short")]
    df = docs(rows)
    out = pipeline.ngram_jaccard_join(spark, df, SF)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(1, one), (None, two), (5, three), (6, four + " end"), (None, None), (None, ""), (9, "short")])
    assert pipeline.ngram_jaccard_join(spark, df.limit(0), SF).count() == 0


def test_a_text_of_50_mb_is_hashed_in_bounded_memory():
    code = """
import resource
import pyarrow as pa
from apexframe.llm import common
texts = pa.array(["w1 foo bar x" * 4_200_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
words, first = common.word_hashes(texts)
common.shingle_hashes(words, 5)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout) < 450  # MB: words at 24 bytes, shingles at 8, and segments


def test_words_over_a_segment_hash_as_short_ones_do():
    long = "x" * (common.SEGMENT * 3 + 5)
    words, first = common.word_hashes(pa.array([long + " ab", "AB " + long, "ab", long.upper() + "y"]))
    assert first.tolist() == [0, 2, 4, 5, 6]
    assert words[0] == words[3] and words[1] == words[2] == words[4] and words[5] not in words[:5]
    data = b" ".join([b"a" * 7] * 40000)
    words, _ = common.word_hashes(pa.array([data.decode()]))
    assert len(words) == 40000 and len(set(words.tolist())) == 1


def test_passages_with_repeated_ids(docs):
    rng = random.Random(23)
    text = lambda n: " ".join(f"i{rng.randrange(90_000)}" for _ in range(n))
    p, q = text(60), text(60)
    rows = [(1, f"{text(20)} {p}"), (1, f"{q} {text(20)}"), (2, f"{p} {text(30)}"), (None, f"{text(9)} {q}"), (3, text(80)), (2, f"{p} x")]
    out = compact_windows.passage_classes(docs(rows)).collect()
    assert len(out) == len(rows) and sorted((r["doc_id"] or 0, r["component_id"], r["links"]) for r in out) == [(0, 1, 1), (1, 1, 1), (1, 1, 2), (2, 1, 2), (2, 1, 2), (3, 3, 0)]
