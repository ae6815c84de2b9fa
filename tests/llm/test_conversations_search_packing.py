"""Conversation repair, ranked search and packing against brute force."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prizelens.llm import conversations, lexical, packing
from prizelens.llm.conversations import damaged, repair_audit, repaired_turns
from prizelens.llm.lexical import ranked_search
from prizelens.llm.packing import pack, padded, pieces
from prizelens.llm.queries import QUERIES
from prizelens.llm.token_files import byte_bpe_encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
TURNS = "conv_id long, turn long, role string, text string, cost string, fault int, audit string"


# ---- conversation repair


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_audit(rows):
    """Whole strings and costs by recursion over rows and places, no pointers."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else (
            "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
        faults.append(fault)
    goes = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    free = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, place, inserts):
        """Cost, letters and turns of the cheapest edits from row i on."""
        options = []
        if i == len(rows):
            if place in ("", "a"):
                options.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            c, s, t = best(i + 1, place, 0)
            options.append((c + 3, "D" + s, t))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role[:1] in goes[place]:
                    c, s, t = best(i + 1, goes[place][role[:1]], 0)
                    options.append((c + more, "K" + s, ((role, text), *t)))
                c, s, t = best(i + 1, free[place], 0)
                options.append((c + 2 + more, "R" + s, ((full[free[place]], text), *t)))
        if inserts < 4:
            c, s, t = best(i, free[place], inserts + 1)
            options.append((c + 2, "I" + s, ((full[free[place]], ""), *t)))
        return min(options) if options else (10**6, "", ())

    turns = [r[1] for r in rows if r[1] is not None]
    marks = [r[2][:1] for r in rows]
    cost, letters, kept = best(0, "", 0)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:])),
        cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    ), kept


def audit_of(rows):
    by_conv = collections.defaultdict(list, {r[0]: [] for r in rows})
    for r in damage(rows):
        by_conv[r[0]].append(r)
    return {conv: plain_audit(own) for conv, own in by_conv.items()}


@pytest.fixture(scope="module")
def turn_rows():
    rng = random.Random(5)
    texts = ["", " \n", "Yes.", "No", "Why? ", "Why?\n", "one.two", "cut off", "end!", "é。", None, "a" * 3000 + "."]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "unknown", "User"]
    rows = []
    for conv in [*range(300), None]:
        order = rng.random()
        for turn in range(rng.randint(1, 9)):
            role = ("user", "assistant")[turn % 2] if order < 0.5 else rng.choice(roles)
            at = None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 3])
            rows.append((conv, at, role, rng.choice(texts)))
    rows += [(7, 2, "user", "Again.")] * 40  # repeated rows
    rows += [(1000, i // 2, rng.choice(roles), rng.choice(texts)) for i in range(400)]
    rows += [(c, 0, "user", "Alone.") for c in range(2000, 2100)]  # some lose their only row
    return rows


@pytest.fixture(scope="module")
def turn_table(spark, turn_rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in turn_rows], TURNS).repartition(5).cache()


@pytest.mark.parametrize("budget", [conversations.SPOOL_BYTES, 300])
def test_repair_against_recursion(turn_rows, turn_table, budget):
    got = {
        (None if x.conv is None else int(x.conv)): tuple(x)[1:]
        for x in repair_audit(damaged(turn_table), budget).collect()
    }
    expected = {conv: a for conv, (a, _) in audit_of(turn_rows).items()}
    assert got == expected
    empty = [a for a in expected.values() if a[6] == "" and a[5] == 0]
    assert empty and set(x[7] for x in empty) == {hashlib.sha256(b"").hexdigest()}
    assert any("I" in a[6] for a in expected.values()) and any("R" in a[6] for a in expected.values())


def test_repaired_turns(turn_rows, turn_table):
    got = collections.defaultdict(list)
    for x in repaired_turns(damaged(turn_table), 300).collect():
        got[None if x.conv is None else int(x.conv)].append((x.position, x.role, x.text, x.edit))
    for conv, (_, kept) in audit_of(turn_rows).items():
        rows = sorted(got[conv])
        assert [r[0] for r in rows] == list(range(len(kept)))
        assert tuple((r[1], r[2]) for r in rows) == kept
        assert re.fullmatch("(s?(ua)+)?", "".join(r[1][0] for r in rows))


def test_no_conversations(turn_table):
    assert repair_audit(damaged(turn_table.limit(0))).count() == 0
    assert repaired_turns(damaged(turn_table.limit(0))).count() == 0


def test_conversation_query(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    expected = audit_of([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    out = QUERIES["op11_conversation_repair"](spark, sf)
    assert out.columns == ["conv_id", *conversations.COUNTS, "audit", "repaired_sha256"]
    assert {r.conv_id: tuple(r)[1:] for r in out.collect()} == {c: a for c, (a, _) in expected.items()}


# ---- ranked search

DOCS = "doc_id long, text string, rank int, score string, item int"


def split(text):
    return [
        "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    ]


def brute_search(docs, items, k):
    terms = [(i, collections.Counter(t), len(t)) for i, x in docs if (t := split(x))]
    n_docs, n_terms = len(terms), sum(n for *_, n in terms)
    df = collections.Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, n in terms:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t in split(text) if c[t]
            )
            if s > 0:
                scores.append((-s, doc is not None, doc or 0))
        for rank, (s, has, doc) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, doc if has else None, -s))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)] + ["Éa", "naïve", "日本", "x-y", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.randint(1, 80)))) for i in range(700)]
    docs += [(i + 700, docs[3][1]) for i in range(60)]  # ties beyond the 20th place
    docs += [(None, "w3 w3 w9"), (None, "w3 w3 w9"), (5, docs[5][1]), (900, None), (901, ""), (902, " -- ")]
    docs.append((903, " ".join(rng.choices(vocab, weights, k=30_000))))
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 25)))) for i in range(30)]
    items += [(50, docs[3][1]), (51, None), (52, ""), (53, "nowhere found"), (None, "w1 W1 w2"), (3, "w4"), (3, "w4")]
    return docs, items


@pytest.mark.parametrize("block,shard", [(400_000, 3_000_000), (40, 500)])
def test_search_against_brute_force(spark, corpus, block, shard):
    docs, items = corpus
    left = spark.createDataFrame([(*d, 1, "s", 2) for d in docs], DOCS).repartition(3)
    right = spark.createDataFrame([(*i, 1, "s", 2) for i in items], DOCS.replace("doc_id", "item_id", 1))
    out = ranked_search(left, right, 20, block, shard)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute_search(docs, items, 20)
    assert ranked_search(left.limit(0), right, 20).count() == 0
    assert ranked_search(left, right.limit(0), 20).count() == 0


def test_best_positions_stop_early():
    """Seen positions end the walk before all documents are looked up, with the same result."""
    rng = np.random.default_rng(2)
    n = 20_000
    impact = np.sort(rng.pareto(1.5, n) * 1000 + 1).astype(np.int64)[::-1]
    order = np.stack([np.argsort(rng.permutation(n) * 0.1 + np.arange(n)) for _ in range(4)])
    term = np.repeat(np.arange(4), n).astype(np.int32)
    lists = lexical.Lists(term, order.ravel().astype(np.int32), np.tile(impact, 4), 4)
    best = lexical.Best(20)
    looked = lexical.best_positions(
        [lists.of(i) for i in range(4)], [1, 2, 1, 1], n, best, lambda d: d.tolist())
    whole = np.zeros(n, np.int64)
    for i, c in enumerate([1, 2, 1, 1]):
        whole[order[i]] += c * impact
    assert best.rows == sorted(zip(whole.tolist(), range(n)), key=lambda r: (-r[0], r[1]))[:20]
    assert looked < n / 4


# ---- packing


def check_packing(rows, texts, capacity, slack):
    """``rows``: pieces; ``texts``: document and text. Every id once, gapless, little padding."""
    library = Tokenizer.from_file(BPE)
    ids = {}
    for key, text in texts:
        own = library.encode(text or "", add_special_tokens=False).ids + [1]
        ids.setdefault(key, collections.Counter())[np.array(own, "<u4").tobytes()] += 1
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for key, own in by_doc.items():
        if sum(ids[key].values()) > 1:  # equal keys: lengths only
            assert sum(r.length for r in own) == sum(len(x) // 4 * n for x, n in ids[key].items())
            continue
        (data,) = ids[key]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(data) // 4
            assert r.ids_crc32 == zlib.crc32(data[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(data) // 4
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert capacity - slack <= at <= capacity or at & (at - 1) == 0
    total = sum(r.length for r in rows)
    return total, len(by_sequence)


@pytest.mark.parametrize("capacity,slack,parts", [(2048, 8, 3), (64, 4, 5), (64, 0, 130)])
def test_packing(spark, capacity, slack, parts):
    rng = random.Random(4)
    texts = [(i, " ".join("word" + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 300)))) for i in range(260)]
    texts += [(300, None), (301, ""), (302, "long " * 30_000), (303, "x<|endoftext|>y"), (None, "no key"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(*t, 1, "z", 2) for t in texts], "doc_id long, text string, start int, ids string, length int")
    encode = byte_bpe_encoder(BPE, public_tokenizers.PATTERN)
    sequences = pack(docs.repartition(parts), "doc_id", "text", encode, capacity, slack).cache()
    rows = pieces(sequences).withColumn("ids_crc32", F.crc32("ids")).collect()
    total, count = check_packing(rows, texts, capacity, slack)
    assert total == sum(s.n_tokens for s in sequences.select("n_tokens").collect())
    lengths = sequences.select("n_tokens", F.octet_length(padded(F.col("ids"), capacity, 0)).alias("n")).collect()
    assert all(x.n == 4 * (x.n_tokens if x.n_tokens & (x.n_tokens - 1) == 0 else capacity) for x in lengths)
    assert sum(x.n // 4 - x.n_tokens for x in lengths) <= slack * count
    assert pack(docs.limit(0), "doc_id", "text", encode, capacity, slack).count() == 0


def test_packing_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = QUERIES["op13_packing"](spark, sf).collect()
    check_packing(rows, [(d.doc_id, d.text) for d in docs], 2048, packing.SLACK)


def test_cut_plan():
    for capacity, slack in ((64, 0), (64, 5), (100, 7)):
        plan = packing.cut_plan(capacity, slack)
        assert all(sum(p) == n and all(capacity % s <= slack for s in p) for n, p in enumerate(plan))
