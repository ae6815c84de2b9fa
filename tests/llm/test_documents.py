"""The document operators against brute force, on awkward tables."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prizelens.llm import linededup, mixcoder, neardup, quality
from prizelens.llm.byte_bpe import ByteBpe, newer_characters
from prizelens.llm.common import Turns, word_count
from prizelens.llm.mixing import mix, mixed_documents
from prizelens.llm.pieces import Pieces, decoded, encoded
from prizelens.llm.token_counts import count_tokens
from prizelens.llm.token_files import byte_bpe_encoder, read_documents, write_ids
from prizelens.session import new_run_dir

BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept int, rate string"
AWKWARD = [
    "", " ", "\n\n", "one", "one two", "a  b\t\n c  ", "x<|endoftext|>y", "naïve ²³ ½ café’s don't I'LL",
    "日本語 テスト", "emoji 😀 ok", "a b   c\x1c\x85d", "▁ is a mark", "a" * 5000, "# $ % & | < >",
]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    out = []
    for i in range(160):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 8))]
        out.append("\n".join(lines))
    for i in range(40):  # near copies of one text, with repeated passages
        words = out[0].split(" ") * 6
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append(" ".join(words))
    out += out[5:15]  # exact copies
    out.append(" ".join(rng.choice(vocab) for _ in range(20_000)))  # a very long text
    out += AWKWARD + [None]
    table = [
        (i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None]), 0, "clash", 7, "r")
        for i, t in enumerate(out)
    ]
    table += [table[3], table[3], (None, "no key here", "en", "s1", 0, None, None, None)]
    return table


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_token_counts(docs, nothing, rows):
    library = Tokenizer.from_file(BPE)
    out = count_tokens(docs, F.col("text"), BPE, public_tokenizers.PATTERN)
    assert set(docs.columns) | {"n_bytes", "n_tokens"} == set(out.columns)
    got = out.collect()
    assert len(got) == len(rows)
    for x in got:
        text = x.text or ""
        assert (x.n_bytes, x.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    assert count_tokens(nothing, F.col("text"), BPE, public_tokenizers.PATTERN).count() == 0


def test_characters_that_regex_engines_class_differently_are_newer():
    newer = newer_characters()
    assert all(newer.match(chr(c)) for c in (0x558, 0x88F, 0xC5C, 0x208F, 0xA7CE, 0x10940, 0x1F600, 0x3D000))
    assert not newer.search("äöü ſ ∀ 日本 ½")
    bpe = ByteBpe(BPE, public_tokenizers.PATTERN)
    for text in AWKWARD:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == bpe.whole(text)


def brute_measures(text):
    w, covered = words_of(text), set()
    count = collections.Counter(zip(w, w[1:], w[2:]))
    for i in range(len(w) - 2):
        if count[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)
    )


def test_quality_measures(docs, nothing, rows):
    got = quality.quality_verdicts(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for x in got:
        want = brute_measures(text[x.doc_id])
        assert tuple(x)[1:6] == want
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (x.base_failed and x.kept)
    assert quality.quality_verdicts(nothing).count() == 0
    kept = sorted((str(x.doc_id) for x in got if x.kept))
    assert sorted(str(x.doc_id) for x in quality.quality_filter(docs).collect()) == kept
    assert quality.quality_filter(docs).columns == docs.columns


def test_junk_goes_and_clean_texts_stay(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["tree", "house", "of", "wind", "river", "stone"]) + str(rng.randint(0, 999)) for _ in range(80)) for _ in range(300)]
    junk = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in c.split()) for c in clean[:30]]
    table = [(i, t, "en", "s") for i, t in enumerate(clean + junk)]
    got = quality.quality_verdicts(spark.createDataFrame(table, "doc_id long, text string, lang string, source string"))
    assert {x.doc_id for x in got.collect() if x.kept} == set(range(300))


def test_sketch_buckets_are_close_and_ordered(spark):
    got = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b")).collect()
    assert all(x.b <= x.id and (x.id - x.b) * quality.STEPS <= x.id and (x.id >= 32 or x.b == x.id) for x in got)
    assert [x.b for x in got] == sorted(x.b for x in got)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(docs, nothing, rows):
    size = word_count(F.col("text"))
    copies, targets = mix(docs, "doc_id", "source", size)
    got, goal = copies.collect(), {x.stratum: x for x in targets.collect()}
    assert sum(x.n for x in got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    want = brute_targets(sizes)
    taken = collections.Counter()
    for x in got:
        assert 0 <= x.copies <= 2
        taken[x.stratum] += x.copies * x.size * x.n
    for s, total in sizes.items():
        assert goal[s].source_size == total and goal[s].target == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(30, 0.02 * want[s])
    again = {(x.id, x.stratum, x.size): x.copies for x in mix(docs, "doc_id", "source", size)[0].collect()}
    assert again == {(x.id, x.stratum, x.size): x.copies for x in got}
    mixed = mixed_documents(docs, "doc_id", "source", size)
    assert mixed.columns == docs.columns and mixed.count() == sum(x.copies * x.n for x in got)
    empty, none = mix(nothing, "doc_id", "source", size)
    assert empty.count() == 0 and none.count() == 0


def sent_whole(df):
    """What the joins of a plan would send through the driver, as Spark expects before it runs."""
    out, todo = [], [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "BroadcastHashJoin":
            out.append(children[0 if node.buildSide().toString() == "BuildLeft" else 1].toString())
        todo += children
    return out


def test_mixing_sends_rates_and_not_documents(docs):
    size = word_count(F.col("text"))
    copies, _ = mix(docs, "doc_id", "source", size)
    assert all("tilt" in side for side in sent_whole(copies))


def brute_components(texts, k):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, nothing, rows, k):
    got = neardup.near_duplicates(docs, k=k).collect()
    assert len(got) == len(rows)
    want = brute_components({r[0]: r[1] for r in rows if r[0] is not None}, k)
    for x in got:
        if x.doc_id is not None:
            assert (x.n_shingles, x.component_id) == want[x.doc_id]
            assert x.kept == (x.doc_id == x.component_id)
    assert neardup.near_duplicates(nothing, k=k).count() == 0
    out = neardup.without_near_duplicates(docs, k=k)
    assert out.columns == docs.columns
    assert {x.doc_id for x in out.collect()} == {x.doc_id for x in got if x.kept}


def test_near_duplicates_go_by_row_and_not_by_key(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    table = [
        (1, text(1)), (None, text(1) + " more"), (None, text(2)), (None, ""), (None, None),  # one copy among null keys
        (5, text(3)), (6, text(4)), (6, text(3)),  # a key with two texts, one of them a copy
        (None, text(5)), (None, text(5)), (7, text(6)), (7, text(6)),  # copies with equal keys
    ]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = neardup.without_near_duplicates(df)
    want = [(1, text(1)), (None, text(2)), (None, ""), (None, None), (5, text(3)), (6, text(4)), (None, text(5)), (7, text(6))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("null_keys", [False, True])
def test_large_groups_and_null_keys_cost_in_proportion(spark, monkeypatch, null_keys):
    """Pairs and texts that are looked at, for 500 near copies and 120 texts with half their words."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]

    def copy():
        at = rng.randrange(200)
        return " ".join([*base[:at], f"v{rng.random()}", *base[at + 1 :]])

    half = lambda: " ".join(base[:120] + [f"u{rng.random()}" for _ in range(80)])
    texts = [copy() for _ in range(500)] + [half() for _ in range(120)]
    rng.shuffle(texts)
    groups = [1 if "u0." in t else 0 for t in texts]
    pairs, read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    verified, set_maker = neardup.verified, neardup.set_maker

    def counted(found, sets, percent):
        found = found.cache()
        pairs.add(found.count())
        return verified(found, sets, percent)

    def counting(k):
        make = set_maker(k)

        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield from make(iter([batch]))

        return run

    monkeypatch.setattr(neardup, "verified", counted)
    monkeypatch.setattr(neardup, "set_maker", counting)
    rows = [(None if null_keys else i, t) for i, t in enumerate(texts)]
    out = neardup.without_near_duplicates if null_keys else neardup.near_duplicates
    got = out(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    if null_keys:
        assert len(got) == 1 + sum(groups)
    else:
        least = min(i for i, g in enumerate(groups) if not g)
        assert {x.doc_id: x.component_id for x in got} == {i: i if g else least for i, g in enumerate(groups)}
    assert pairs.value < 60 * len(texts)
    assert read.value <= len(texts)


def test_entries_and_bands_are_not_sent_whole(spark, monkeypatch):
    """Exploded rows and arrays are many times what Spark takes them for."""
    seen, keep = collections.defaultdict(list), Turns.stored

    def recorded(self, df, label):
        seen[label].append(sent_whole(df))
        return keep(self, df, label)

    monkeypatch.setattr(Turns, "stored", recorded)
    common = [f"w{i}" for i in range(70)]
    rows = [(i, " ".join(common + [f"u{i}x{j}" for j in range(40)])) for i in range(60)]
    assert neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 60
    assert len(seen["minhash-entries"]) > 3  # entries were dealt to finer ones
    assert not [side for sides in seen["minhash-entries"] for side in sides if "Generate" in side or "bands" in side]


def test_tensored_bands_share_a_table_where_sets_are_similar():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(300):
        common = rng.integers(0, 1 << 62, 400, np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 50, np.uint64)])) for _ in range(2))
        same = neardup.band_hashes(a) == neardup.band_hashes(b)
        missed += not (same[: neardup.SIDE].any() and same[neardup.SIDE :].any())
    assert missed <= 3


def test_line_dedup(docs, nothing, rows):
    out = linededup.dedup_lines(docs)
    assert set(docs.columns) | {"n_lines", "n_removed"} == set(out.columns)
    table = sorted({(r[0] if r[0] is not None else -1, r[1]) for r in rows}, key=lambda r: (r[0], r[1] or ""))
    first, places = {}, []
    for i, text in table:
        lines = linededup.text_lines(text)
        for a, n, _ in sorted(linededup.chunks(lines)):
            part = b"\n".join(lines[a : a + n])
            first.setdefault(part, (i, a))
            places.append((i, a, n, part))
    gone = collections.defaultdict(set)
    for i, a, n, part in places:
        if first[part] != (i, a):
            gone[i] |= set(range(a, a + n))
    want = {i: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]) for i, t in table}
    got = out.collect()
    assert len(got) == len(rows) and any(x.n_removed for x in got)
    for x in got:
        assert x.text == want[-1 if x.doc_id is None else x.doc_id]
    assert linededup.dedup_lines(nothing).count() == 0


def test_shared_passages_are_cut_alike_and_go(spark):
    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    passage = [line(12) for _ in range(12)]
    texts = [[line(10) for _ in range(rng.randint(1, 5))] + passage + [line(9)] for _ in range(6)]
    long = line(60)
    texts += [[line(7), long], [long, line(8)]]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in linededup.dedup_lines(df).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed >= 6 for i in range(1, 6))
    assert got[6].n_removed == 0 and got[7].text == texts[7][1]


@pytest.mark.parametrize("n_lines, n_words", [(2, 26), (3, 18), (4, 13), (7, 27), (55, 1)])
def test_passages_of_few_lines_go_whole(spark, n_lines, n_words):
    rng = random.Random(n_lines)
    line = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    texts, want = [], {}
    for i in range(20):  # pairs of documents that share one passage amid other lines
        passage = [line(n_words) for _ in range(n_lines)]
        for j in (0, 1):
            head, tail = [line(9)] * rng.randint(1, 3), [line(8)] * rng.randint(1, 3)
            texts.append((2 * i + j, "\n".join(head + passage + tail)))
            want[2 * i + j] = (n_lines if j else 0, passage)
    got = linededup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    for x in got:
        removed, passage = want[x.doc_id]
        assert x.n_removed >= removed and ("\n".join(passage) in x.text) == (removed == 0)
        assert removed == 0 or not set(passage) & set(x.text.split("\n"))


def test_rows_that_repeat_cost_in_proportion(spark):
    text = "\n".join(f"line {i} of a text with some words in it" for i in range(30))
    rows = [(1, text)] * 200 + [(2, text), (None, text), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    slim = df.select("doc_id", F.lit(7).cast("long").alias("tag"), "text")
    assert all(len(x.spans) == len({(s.start, s.n) for s in x.spans}) for x in linededup.repeated_places(slim).collect())
    got = linededup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    # The null key comes first and keeps its text.
    assert all((x.text == text) if x.doc_id is None else x.n_removed == 30 for x in got)


def test_a_repeated_line_keeps_one_passage(spark):
    texts = [(1, "\n".join(["word"] * 120)), (2, "\n".join(["word"] * 119))]
    spans = linededup.repeated_places(spark.createDataFrame(
        [(i, i, t) for i, t in texts], "doc_id long, tag long, text string"
    )).collect()
    gone = {x.doc_id: {i for s in x.spans for i in range(s.start, s.start + s.n)} for x in spans}
    assert len(gone[2]) == 119 and not gone[1] & {0, 1}


def test_pieces(docs, nothing, rows):
    model = Pieces(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in [r[1] for r in rows if r[1] and "▁" not in r[1]][:80]:
        assert np.frombuffer(model.encode(text, 1, 1, 0.0), "<i4").tolist() == library.encode(text)
    ids = docs.withColumn("ids", encoded(F.col("text"), F.col("doc_id"), PIECES, seed=4, dropout=0.2))
    got = ids.withColumn("back", decoded(F.col("ids"), PIECES)).collect()
    assert len(got) == len(rows) and all(x.back == x.text for x in got)
    again = docs.repartition(3).withColumn("ids", encoded(F.col("text"), F.col("doc_id"), PIECES, seed=4, dropout=0.2))
    key = lambda x: (str(x.doc_id), x.text or "")
    assert sorted((key(x), x.ids) for x in again.collect() if x.text) == sorted((key(x), x.ids) for x in got if x.text)
    plain = library.encode(rows[0][1])
    varied = {model.encode(rows[0][1], doc, 4, 0.2) for doc in range(6)}
    assert len(varied) > 1 and all(len(v) // 4 > len(plain) for v in varied)
    assert ids.where(F.size("ids") == 0).where("text <> ''").count() == 0
    assert nothing.withColumn("ids", encoded(F.col("text"), F.col("doc_id"), PIECES)).count() == 0


def test_every_occurrence_draws_its_own_form(rows):
    model = Pieces(PIECES)
    for text in [r[1] for r in rows if r[1]][:60] + AWKWARD:
        units = model.unit.findall(" " + text) if text else []
        keys = model.draws(len(units), 7, 1)
        want = [np.array(model.segment(u, int(k), 1 << 29), "<i4").tobytes() for u, k in zip(units, keys)]
        assert model.encode(text, 7, 1, 0.125) == b"".join(want)
    forms = {model.encode("international", doc, 1, 0.3) for doc in range(400)}
    assert len(forms) > 4


def test_units_that_do_not_come_again_are_segmented_once(monkeypatch):
    """Rows that are segmented, for words that occur once and for words that occur often."""
    model, rows, many = Pieces(PIECES), [], Pieces.segment_many
    monkeypatch.setattr(
        Pieces, "segment_many", lambda self, units, *a, **b: rows.append(len(units)) or many(self, units, *a, **b)
    )
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("aeinrstlou", k=9))
    rare = [word() for _ in range(3000)]
    model.encode(" ".join(rare), 1, 1, 0.125)
    assert sum(rows) <= len(rare)
    often = " ".join(rare[:50] * 40)
    rows.clear()
    ids = model.encode(often, 2, 1, 0.125)
    assert sum(rows) < 1000
    units = model.unit.findall(" " + often)
    keys = model.draws(len(units), 2, 1)
    want = [np.array(model.segment(u, int(k), 1 << 29), "<i4").tobytes() for u, k in zip(units, keys)]
    assert ids == b"".join(want)


def test_pieces_decode_lists_of_ids():
    model = Pieces(PIECES)
    texts = ["two  spaces ", "", None, " \u2581 \u65e5\u672c \U0001f600\n", " lead", "end"]
    ids = [None if t is None else np.frombuffer(model.encode(t, 5, 1, 0.5), "<i4").tolist() for t in texts]
    lists = pa.array([[1], *ids], pa.list_(pa.int32()))
    assert model.decode(lists.slice(1)).to_pylist() == texts
    assert model.decode(lists.slice(0, 0)).to_pylist() == []


@pytest.mark.parametrize("bits", [8, 12, 16, 17, 24])
def test_range_coder_round_trip(bits):
    rng = np.random.default_rng(bits)
    blocks = [rng.integers(0, 1 << bits, n) for n in (1, 300, 1200)]
    blocks += [np.zeros(2500, int), np.full(5, (1 << bits) - 1), np.resize(rng.integers(0, 1 << bits, 40), 3000)]
    blocks.sort(key=lambda b: -len(b))
    codes = mixcoder.encode_blocks(blocks, bits)
    back = mixcoder.decode_blocks(codes, np.array([len(b) for b in blocks]), bits)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    assert len(codes[[len(b) for b in blocks].index(2500)]) < 60


def test_token_files(spark, docs, nothing, rows):
    library = Tokenizer.from_file(BPE)
    folder = new_run_dir(spark, "ids-test")
    encode = byte_bpe_encoder(BPE, public_tokenizers.PATTERN)
    files = write_ids(docs, "doc_id", "text", folder, encode, 16)
    got = sorted(read_documents(files, folder).collect(), key=lambda x: x.start)
    assert len(got) == len(rows)
    keys = [-1 if x.doc_id is None else x.doc_id for x in got]
    assert keys == sorted(keys)
    text, at = {r[0]: r[1] for r in rows}, 0
    for x in got:
        ids = np.array(library.encode(text[x.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = new_run_dir(spark, "ids-test")
    assert read_documents(write_ids(nothing, "doc_id", "text", empty, encode, 16), empty).count() == 0
