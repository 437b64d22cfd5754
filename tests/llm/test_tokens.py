"""Units of texts, alignment of two tokenizers and packing, against the tokenizers themselves and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from oracle import SF
from tokenizers import Tokenizer

from apexframe.llm import alignment, packing, queries, tokens

A, B, C = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
PARTS = [" ", "  ", "\n", "\n\n", ".", ",", "a", "B", "é", "ñ", " ", "　", " ", "▁", "中", "文", "<|endoftext|>", "'s", "'ll", "1", "23", "\t", "Σ", "é", "́", "-", "x.", "The", " the", "<s>", "😀", "\x1c", "\x85", "×", "İ"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)]


def some_texts(spark):
    return [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def ids_of(column, memo):
    ids, at = tokens.encode_column(pa.array(column), memo)
    return [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)]


def test_units_give_the_ids_of_whole_texts(spark):
    for texts in (odd_texts(4000), some_texts(spark)):
        whole = Tokenizer.from_file(C)
        assert ids_of(texts, tokens.word_memo(C)) == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
        whole = Tokenizer.from_file(A)
        whole.encode_special_tokens = True
        spaced = [" " + t for t in texts]
        assert ids_of(spaced, tokens.byte_level(A)[0]) == [x.ids for x in whole.encode_batch(spaced, add_special_tokens=False)]
        texts = [t for t in texts if t]
        whole = sentencepiece.SentencePieceProcessor(model_file=B)
        assert ids_of([" " + t for t in texts], tokens.sentence_pieces(B)[0]) == whole.encode(texts)


def spelled(ids, spelling):
    ends, at = [], 0
    for i in ids:
        at += len(spelling[i])
        ends.append(at)
    return b"".join(spelling[i] for i in ids), ends


def brute_alignment(texts):
    """Cuts as a set intersection, links by comparing all ranges of a group's tokens."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    a_bytes, b_bytes = tokens.byte_level(A)[1], tokens.sentence_pieces(B)[1]
    out, holds = [], Counter()
    for t in texts:
        row = {"a": [], "b": [], "groups": [], "links": []}
        if t:
            a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
            (x, ends_a), (y, ends_b) = spelled(a, a_bytes), spelled(b, b_bytes)
            if x == y == (" " + t).encode():
                row |= {"a": a, "b": b}
                cuts, i, j = sorted({*ends_a} & {*ends_b}), 0, 0
                for c in cuts:
                    p, q = ends_a.index(c) + 1, ends_b.index(c) + 1
                    row["groups"].append((a[i:p], b[j:q]))
                    row["links"] += [(a[k], b[m]) for k in range(i, p) for m in range(j, q) if (ends_a[k - 1] if k else 0) < ends_b[m] and (ends_b[m - 1] if m else 0) < ends_a[k]]
                    i, j = p, q
        holds.update({*row["links"]})
        out.append(row)
    most = defaultdict(int)
    for (a, _), n in holds.items():
        most[a] = max(most[a], n)
    for row in out:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in row["groups"])
        row["figures"] = (len(row["a"]), len(row["b"]), len(row["groups"]), len(row["links"]), sum(holds[x] == most[x[0]] for x in row["links"]), sum(holds[x] for x in row["links"]), hashlib.sha256(text.encode()).hexdigest() if row["a"] else "")
    return [row["figures"] for row in out]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("bound", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_equals_brute_force(spark, docs, bound):
    texts = [None, "", "", " ", "▁", "a ▁ b", "same words", "same words", "x" * 3000, "日本語のテキスト " * 40, "ab­cd " * 200, *odd_texts(300, 7), *some_texts(spark)[:60]]
    out = alignment.align(docs(list(enumerate(texts))).repartition(5), A, B, bound).collect()
    want = brute_alignment(texts)
    assert len(out) == len(texts)
    for r in out:
        assert tuple(r[c] for c in NAMES) == want[r["doc_id"]], texts[r["doc_id"]]


def test_alignment_of_an_empty_table(docs):
    assert alignment.align(docs([]), A, B).count() == 0


def test_long_stretches_without_a_common_end():
    rng = np.random.default_rng(3)
    for _ in range(300):
        texts = rng.integers(1, 4)
        a, b, first_a, first_b, base = [], [], [0], [0], 0
        for _ in range(texts):
            n = int(rng.integers(2, 400))
            inner_a, inner_b = (sorted(rng.choice(np.arange(1, n), int(rng.integers(0, n) ** rng.random()), replace=False)) for _ in "ab")
            a += [base + x for x in inner_a] + [base + n]
            b += [base + x for x in inner_b] + [base + n]
            first_a.append(len(a))
            first_b.append(len(b))
            base += n
        ga, gb = alignment.common_ends(*map(np.array, (a, b, first_a, first_b)))
        both = sorted({*a} & {*b})
        assert [a[i - 1] for i in ga] == both == [b[i - 1] for i in gb]
        la, lb = alignment.links_of(np.array(a), np.array(b), ga, gb)
        starts = lambda e: [0, *e[:-1]]
        want = [(i, j) for i, (s, e) in enumerate(zip(starts(a), a, strict=True)) for j, (t, f) in enumerate(zip(starts(b), b, strict=True)) if s < f and t < e]
        assert list(zip(la.tolist(), lb.tolist(), strict=True)) == want


# --- packing ---------------------------------------------------------------------------------------------------------


def check_packing(rows, texts, capacity):
    """Whole documents, gapless sequences within capacity, ids as the tokenizer gives them."""
    whole, by_doc, by_sequence = Tokenizer.from_file(C), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in texts:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        got = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got] == [(k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    return len(by_sequence), -(-total // capacity)


def test_packing_of_odd_and_long_texts(spark, docs):
    texts = list(enumerate([None, "", " \n ", "a", "a", "<|endoftext|> x", "word " * 9000, *odd_texts(200, 5), *some_texts(spark)]))
    df = docs(texts)
    rows = packing.token_pieces(df, C, 512)
    rows = packing.materialize(rows.withColumn("ids_crc32", packing.F.crc32("ids")), "test")
    placed = packing.materialize(packing.place(rows, 512), "test")
    used, least = check_packing(placed.collect(), texts, 512)
    assert used <= 1.02 * least + 1
    for r in packing.sequences(placed).collect():
        ids = np.frombuffer(r["ids"], "<u4")
        ends = np.cumsum(r["lengths"])
        assert len(ids) == ends[-1] <= 512
        assert all(ids[e - 1] == 1 or n == 512 for e, n in zip(ends, r["lengths"], strict=True))
    assert packing.place(packing.materialize(packing.token_pieces(docs([]), C), "test")).count() == 0


def test_query_packs_all_documents(spark):
    rows = queries.queries()["op13_pattern_packing"](spark, SF).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    used, least = check_packing(rows, texts, 4096)
    assert used <= least + 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = [64, 100, 512, 4096, 4096, 1000][seed]
    counts = np.zeros(capacity + 1, np.int64)
    lengths = np.clip(rng.lognormal(np.log(capacity / 4), 0.9, 3000).astype(int), 1, capacity)
    np.add.at(counts, lengths, 1)
    counts[capacity // 3] += 2000
    groups = packing.plan(counts, capacity)
    used = np.zeros_like(counts)
    for times, items in groups:
        assert 0 < sum(n * k for n, k in items) <= capacity
        for n, k in items:
            used[n] += times * k
    assert (used == counts).all()
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    assert sum(t for t, _ in groups) <= 1.03 * least + 1


def test_fit_equals_the_counts_where_patterns_allow_it():
    patterns = packing.patterns_of(np.array([1, 2, 3, 4, 5, 6, 8]), 8, 4)
    assert {tuple(p) for p in patterns} == {p for p in ((8, 0, 0, 0), (6, 2, 0, 0), (6, 1, 1, 0), (5, 3, 0, 0), (5, 2, 1, 0), (5, 1, 1, 1), (4, 4, 0, 0), (4, 3, 1, 0), (4, 2, 2, 0), (4, 2, 1, 1), (3, 3, 2, 0), (3, 3, 1, 1), (3, 2, 2, 1), (2, 2, 2, 2))}
    want = np.zeros(len(patterns))
    want[[1, 4, 9]] = 10, 20, 5
    counts = np.zeros(9)
    for n, p in zip(want, patterns, strict=True):
        np.add.at(counts, p[p > 0], n)
    fit = packing.nonnegative_fit(patterns, counts)
    got = np.zeros(9)
    for n, p in zip(fit, patterns, strict=True):
        np.add.at(got, p[p > 0], n)
    assert (fit >= 0).all() and np.abs(got - counts).max() < 1e-4


def test_shared_folder_where_no_setting_names_one(spark):
    """A session without spark.checkpoint.dir: the context's folder, set once on one machine; an error on a cluster."""
    from apexframe.llm.common import shared_dir

    class Unset:
        def __init__(self, master, known):
            self.master, self.known, self.sparkContext, self.conf = master, known, self, self
            self._jvm, self._jsc = spark._jvm, spark.sparkContext._jsc
            self._jsc = type("J", (), {"sc": lambda _: self, "hadoopConfiguration": lambda _: spark._jsc.hadoopConfiguration()})()

        def get(self, *_):
            return None

        def getCheckpointDir(self):
            known = self.known
            return type("O", (), {"isDefined": lambda _: known is not None, "get": lambda _: known})()

        def setCheckpointDir(self, path):
            self.known = path

    assert shared_dir(Unset("yarn", "file:/tmp/given"), "x").startswith("file:/tmp/given/apexframe/x-")
    local = Unset("local[2]", None)
    assert "/apexframe-checkpoints-" in shared_dir(local, "x") and "/apexframe-checkpoints-" in local.known
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Unset("yarn", None), "x")
