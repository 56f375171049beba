import math
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointspark.llm import queries as q
from pointspark.llm.common import row_keys
from pointspark.llm.op1_substring_dedup import SENTENCE, remove_repeats
from pointspark.llm.op2_ngram_join import ORDERS, features, keep_one_each, ngram_components, prefix, prefix_size, signature, surviving, verified
from pointspark.shared import materialize
from pointspark.llm.op3_sstable import ShardReader, ShardWriter, key_of, open_shard, token_shards, write_shards
from pointspark.llm.op5_langid import UND, Ranker, grams, identify, learn
from pointspark.llm.op6_packing import best_two_fit, encode_pieces, pack, plan, segments
from pointspark.llm.op9_mixing import mix, mixed_rows
from pointspark.llm.op10_line_dedup import chunk_bounds, dedup_lines
from pointspark.llm.tokens import Encoder

BYTES, WORDS = q.vocabulary(q.BYTE_BPE), q.vocabulary(q.WORD_BPE)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def long_runs(words, span, least):
    """Runs of sentences, by their counts of words, from each start and back from each end."""
    n, runs = len(words), set()
    fits = lambda i, e: e - i >= span and sum(words[i:e]) >= least
    for at in range(n):
        runs |= {next(((at, e) for e in range(at + 1, n + 1) if fits(at, e)), None), next(((i, at + 1) for i in range(at, -1, -1) if fits(i, at + 1)), None)}
    return sorted(runs - {None})


def lengthened_spans(docs, span, least=20):
    """Texts without repeated runs of sentences, each as long as it must be."""
    cut = {d: re.findall(SENTENCE, t) for d, t in docs if t is not None}
    norm = {d: [" ".join(re.split(r"[\x20\x09-\x0D]+", s)).strip(" ").lower() for s in ss] for d, ss in cut.items()}
    runs = {d: long_runs([len(s.split(" ")) if s else 0 for s in ss], span, least) for d, ss in norm.items()}
    first, out = {}, {}
    for d in sorted(norm):
        for i, e in runs[d]:
            first.setdefault(tuple(norm[d][i:e]), (d, i, e))
    for d, ss in cut.items():
        gone = {j for i, e in runs[d] if first[tuple(norm[d][i:e])] != (d, i, e) for j in range(i, e)}
        out[d] = "".join(s for j, s in enumerate(ss) if j not in gone)
    return out


def test_op1_equals_brute_force_of_lengthened_runs(documents, odd):
    texts = texts_of(documents) + [(d + 10_000, t) for d, t in dict(texts_of(odd.filter("doc_id is not null"))).items()]
    docs = documents.sparkSession.createDataFrame(texts, "doc_id long, text string")
    assert dict(texts_of(remove_repeats(docs, span=3))) == {d: None for d, t in texts if t is None} | lengthened_spans(texts, 3)


def test_op1_passage_of_one_word_sentences(spark):
    passage = " ".join(f"w{i}!" for i in range(60))
    few = "Long words stand here before it all. One. Two. "
    docs = spark.createDataFrame([(1, "Own text. " + passage), (2, few + passage + " Three more."), (3, "Not. The. Same. w1! w2! w3! w4! w5! w6!")], "doc_id long, text string")
    by = {r["doc_id"]: r for r in remove_repeats(docs, span=3).collect()}
    assert by[1]["n_removed"] == 0 and by[3]["n_removed"] == 0  # six words are met by chance
    assert by[2]["n_removed"] == 60 and by[2]["text"] == few + "Three more."


def test_op1_two_sentences_of_fifty_words(documents, spark):
    """By default two sentences are enough, also where both neighbours are joined to other text."""
    one, two = " ".join(f"a{i}" for i in range(26)) + ". ", " ".join(f"b{i}" for i in range(26)) + ". "
    docs = spark.createDataFrame([(1, "Here it begins. " + one + two + "It ends."), (2, "Another start of it and tail one. " + one + two + "Something else follows here.")], "doc_id long, text string")
    by = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert by[1]["n_removed"] == 0 and by[2]["text"] == "Another start of it and tail one. Something else follows here."
    texts = texts_of(documents)
    assert dict(texts_of(remove_repeats(documents.select("doc_id", "text")))) == lengthened_spans(texts, 2)


def test_op1_odd_rows(odd, none):
    out = remove_repeats(odd).collect()
    assert len(out) == 12 and set(odd.columns) <= set(remove_repeats(odd).columns)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["n_removed"] == 0  # the first of its copies, in both of its rows
    assert by[2]["text"] == "" and by[None]["text"] == ""
    assert by[3]["text"] is None and by[3]["n_sentences"] == 0
    assert by[9]["text"] == "unlike line here."
    assert remove_repeats(none).count() == 0


def test_op2_equals_brute_force(spark, sf, documents):
    sets, comp = brute.near_copies(texts_of(documents))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q.op2_ngram_jaccard_join(spark, sf).collect()}
    assert got == {d: (len(sets[d]), comp[d]) for d in sets}


def test_op2_finds_chains_in_a_large_group(spark):
    """Near copies of one text, some linked only through others; tables far too small for the corpus change nothing."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for d in range(150):
        w = list(base)
        for at in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            w[at] = f"x{rng.integers(0, 40)}"
        docs.append((d, " ".join(w)))
    sets, comp = brute.near_copies(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for options in ({}, {"bits": 8, "entries": 64}):
        got = {r["doc_id"]: r["component_id"] for r in ngram_components(df, **options).collect()}
        assert got == comp
    assert 1 < len(set(comp.values())) < 150


def test_op2_keeps_texts_that_only_share_an_identifier(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a + " more"), (5, b), (7, b + " more"), (9, c), (9, c), (9, "other words only"), (9, None), (None, c)]
    out = keep_one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in out) == Counter([(3, a), (5, b), (9, c), (9, "other words only"), (9, None), (None, c)])


def test_op2_odd_rows(odd, none):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_components(odd).collect()]
    assert Counter(rows)[(1, 16, 1)] == 2 and (2, 16, 1) in rows and (9, 19, 1) in rows
    assert {(3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 7), (10, 1, 10), (None, 16, None)} <= set(rows)
    assert ngram_components(none).count() == 0
    kept = keep_one_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7, 8, 10]


@given(st.sets(st.integers(0, 60), max_size=60), st.sets(st.integers(0, 60), max_size=60), st.sampled_from([50, 75, 90]))
@settings(max_examples=200, deadline=None)
def test_op2_filters_lose_no_link(a, b, percent):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    if a and b and 100 * len(a & b) >= percent * len(a | b):
        for salt in (5, *ORDERS):
            p, q = (prefix(s, (s % np.uint64(5)).astype(np.int64), prefix_size(len(s), percent), salt) for s in (x, y))
            assert np.isin(p, q).any()
    bits = sum(int(v).bit_count() for v in signature(x, 2) ^ signature(y, 2))
    assert bits <= len(a ^ b)


def test_op2_orders_are_intersected_before_verification(spark):
    """Pairs after each order: fewer each time, before any set is read, and never a link less."""
    rng = np.random.default_rng(7)
    phrases = [" ".join(f"p{j}w{i}" for i in range(14)) for j in range(80)]  # what unlike documents have in common
    docs = [(d, " ".join(phrases[j] for j in rng.choice(80, 12, replace=False))) for d in range(150)]
    base = [f"b{i}" for i in range(80)]
    docs += [(200 + d, " ".join([*base[: 70 + d % 10], f"e{d}"])) for d in range(20)]
    twins = spark.createDataFrame([(d, t) for d, t in docs] + [(1000 + d, t + " more") for d, t in docs[:60]], "doc_id long, _text string")
    classes = materialize(features(twins, 5, 75, 20, 1 << 10).filter("size(pre) > 0").withColumnRenamed("n_shingles", "n"))
    posts = classes.selectExpr("doc_id", "explode(pre) t")
    pairs = materialize(posts.toDF("a", "t").join(posts.toDF("b", "t"), "t").filter("a < b").select("a", "b").distinct())
    steps = [pairs.count(), *(surviving(pairs, classes, 75, i, signatures=False).count() for i in range(len(ORDERS) + 1)), surviving(pairs, classes, 75).count()]
    assert steps == sorted(steps, reverse=True) and len({*steps[1:-1]}) == 1 + len(ORDERS), steps
    found = {tuple(r) for r in verified(materialize(surviving(pairs, classes, 75)), classes, 75).collect()}
    sets = {r["doc_id"]: brute.shingles(r["_text"]) for r in twins.collect()}
    assert found == {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}


ODD_TEXTS = ["", " ", "\n", "a  b", " a", "a ", "a\n\nb", "a \n b", "tab\tx y", "x\r\ny z", "don't we'll I'M", "é x", "x ́y", "a b 　c", "<|endoftext|> hi", "a<|startoftext|>b", "<|endoftext", "<|ENDOFTEXT|>a", "日本語 テスト", "İstanbul ΣΑΣ Σ", "a\x1cb \x1c", "9 99 $$ !! ..", "foo 's bar", "foo\n's 'll", "Ünïcode, wörds."]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(documents, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    e = Encoder(path, cache=50)  # generations turn over
    for text in [*ODD_TEXTS, *[x for _, x in texts_of(documents)][:80]]:
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


@given(st.text(alphabet="aB é\n\t.,'s1", max_size=30))
@settings(max_examples=200, deadline=None)
def test_encoder_on_any_text(text):
    for path in (BYTES, WORDS):
        e = _encoders.setdefault(path, Encoder(path))
        assert np.frombuffer(e.encode(text), e.dtype).tolist() == e.t.encode(text, add_special_tokens=False).ids


_encoders = {}


def ids_of(text, path, end):
    e = _encoders.setdefault(path, Encoder(path))
    return [*e.t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_round_trip(spark, sf, documents):
    start, want = 0, []
    for d, t in sorted(texts_of(documents)):
        ids = ids_of(t, BYTES, 0)
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, q.op3_sstable_shards(spark, sf).collect())) == want


def test_op3_look_ups(spark, documents, tmp_path):
    docs = dict(texts_of(documents))
    manifest = write_shards(documents, f"file://{tmp_path}/out", BYTES, block_bytes=4096).collect()
    assert sum(r["n_docs"] for r in manifest) == len(docs)
    readers = [open_shard(r["path"]) for r in manifest]
    for d in list(docs)[::7]:
        found = [ids.tolist() for r in readers for ids in r.get(d)]
        assert found == [ids_of(docs[d], BYTES, 0)]
    assert not any(r.get(10**9) for r in readers)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_op3_damage_is_noticed(tmp_path):
    path = tmp_path / "x.sst"
    with path.open("wb") as f:
        w = ShardWriter(f, 2)
        for i in range(100):
            w.add(key_of(i, 0), b"ab" * 50)
        w.close()
    import pyarrow as pa

    raw = bytearray(path.read_bytes())
    assert len(list(ShardReader(pa.OSFile(str(path))).scan())) == 100
    raw[10] ^= 1
    path.write_bytes(raw)
    with pytest.raises(ValueError):
        list(ShardReader(pa.OSFile(str(path))).scan())
    path.write_bytes(raw[:-1])
    with pytest.raises(ValueError):
        ShardReader(pa.OSFile(str(path)))


def test_op3_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in token_shards(spark, odd, BYTES).orderBy("start").collect()]
    assert [r[0] for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [r[1] for r in rows] == list(np.cumsum([0, *(r[2] for r in rows)])[:-1])
    assert {r[0]: r[2] for r in rows}[3] == 1
    assert token_shards(spark, none, BYTES).count() == 0


def test_op5_held_out_accuracy(spark, sf, documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    got = q.op5_language_id(spark, sf).collect()
    test = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and 40 < len(test) < 100
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in test) >= 0.97 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got)


def plain_rank_distance(text, profiles, size):
    """Out-of-place distance by dictionaries."""
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = f" {' '.join(t.split(' '))} "
    t = re.sub(" +", " ", f" {t} ")
    count = Counter(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))
    for g in [g for g in count if g == " " or (len(g) == 3 and g[1] == " ")]:
        del count[g]
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    own = [g for _, _, g in sorted((-n, code(g), code(g)) for g, n in count.items())][:size]
    best = []
    for name in sorted(profiles):
        place = {int(c): i for i, c in enumerate(profiles[name])}
        best.append((sum(min(size, abs(place[g] - i)) if g in place else size for i, g in enumerate(own)), name))
    cost, name = min(best)
    return name, 1 - cost / (size * len(own))


def test_op5_distances_equal_brute_force(documents):
    profiles = learn(documents, sample_rows=100, profile_size=120)
    ranker = Ranker(profiles, 120)
    assert sorted(profiles) == ["de", "en", "es", "fr"]
    for _, text in texts_of(documents)[:40]:
        name, score = ranker.predict(text)
        want = plain_rank_distance(text, profiles, 120)
        assert name == want[0] and score == pytest.approx(want[1])


def test_op5_learns_every_label(spark):
    rows = [(i, f"text of its own {chr(0x4E00 + i // 4) * 3}", f"l{i // 4}") for i in range(2400)]
    profiles = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learned = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert len(learned) > 550 and set(profiles) == learned
    ranker = Ranker(profiles)
    assert all(ranker.predict(t)[0] == lang for _, t, lang in rows[:2400:100] if lang in learned)


def test_op5_odd_rows(odd, none):
    got = identify(odd, learn(odd))
    assert got.columns == [*odd.columns, "lang_pred", "score"]
    by = {r["doc_id"]: r["lang_pred"] for r in got.collect()}
    assert got.count() == 12 and {by[i] for i in (3, 4, 5, 6)} == {UND} and by[2] != UND
    assert learn(none) == {} and identify(none, {}).count() == 0
    assert {r["lang_pred"] for r in identify(odd, {}).collect()} == {UND}
    assert not len(grams("12 3")[0]) and not len(grams(None)[0])


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_op6_plans_use_everything_once(counts):
    runs = plan(counts, 40)
    used = Counter()
    for times, bin_ in runs:
        assert times > 0 and sum(bin_) <= 40
        for size in bin_:
            used[size] += times
    assert used == Counter(counts)
    total = sum(s * n for s, n in counts.items())
    assert sum(t for t, _ in runs) <= max(1, 2 * total / 40 + 1)
    seg = segments(runs)
    assert int(seg[:, 2].sum()) == sum(counts.values())


def plain_best_two_fit(counts, capacity):
    """Bins one after the other over a plain multiset."""
    left, bins = Counter(counts), []
    while left := +left:
        bin_, room = [], capacity
        while fits := [s for s in left if left[s] and s <= room]:
            bin_.append(max(fits))
            left[bin_[-1]] -= 1
            room -= bin_[-1]
        last, gap = bin_[-1], room + bin_[-1]
        left[last] += 1
        sizes = sorted(+left)
        pairs = [(a + b, -a, b) for i, a in enumerate(sizes) for b in sizes[i:] if a + b <= gap and (a != b or left[a] > 1)]
        best = max(pairs, default=(0, 0, 0))
        swap = [-best[1], best[2]] if room and best[0] > last else [last]
        left.subtract(swap)
        bins.append(tuple(sorted(bin_[:-1] + swap)))
    return Counter(bins)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=12))
@settings(max_examples=200, deadline=None)
def test_op6_plan_equals_best_two_fit(counts):
    got = Counter()
    for times, bin_ in plan(counts, 40):
        got[tuple(sorted(bin_))] += times
    assert got == plain_best_two_fit(counts, 40)


def test_op6_hot_rows(spark):
    """One document on a third of all rows: its rows are dealt to several groups and packed all the same."""
    rows = [(7, "the same words")] * 150 + [(i, f"words of {i} " * (1 + i % 9)) for i in range(300)]
    pieces = encode_pieces(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, with_ids=False)
    got = pack(pieces, group_rows=10).collect()
    check_packing(got)
    assert len(got) == 450 and len({(r["sequence_id"], r["offset"]) for r in got}) == 450


def check_packing(rows, capacity=4096):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return len(by)


def test_op6_packs_every_piece(spark, sf, documents):
    rows = q.op6_best_fit_packing(spark, sf).collect()
    n = check_packing(rows)
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 4096) + 1
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for d, t in sorted(texts_of(documents)):
        ids = ids_of(t, WORDS, 1)
        want += [(d, i, s, len(ids[s : s + 4096]), crc(ids[s : s + 4096])) for i, s in enumerate(range(0, len(ids), 4096))]
    assert got == want


def test_op6_odd_rows(odd, none):
    rows = best_two_fit(odd, WORDS, with_ids=True).collect()
    check_packing(rows)
    lengths = defaultdict(int)
    for r in rows:
        lengths[r["doc_id"]] += r["length"]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert lengths[3] == lengths[4] == lengths[5] == 1 and lengths[7] == 30_001 and lengths[1] == 2 * lengths[2]
    assert best_two_fit(none, WORDS).count() == 0


def water_fill(sizes, weights, total):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else rest * w[s] / sum(w[f] for f in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s] * (1 + 1e-12)}
        if not over:
            return target
        capped |= over


def count_words(t):
    return len(t.encode().split()) if t else 0


def test_op9_targets_and_takings(spark, sf, documents):
    rows = q.op9_source_mixing(spark, sf).collect()
    docs = {r["doc_id"]: r for r in documents.collect()}
    per = Counter()
    for r in docs.values():
        per[r["source"]] += count_words(r["text"])
    target = water_fill(per, (5, 2, 1), 1.5 * sum(per.values()))
    taken, largest = Counter(), Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == count_words(d["text"]) and r["source_size"] == per[d["source"]]
        assert r["target"] == pytest.approx(target[d["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[d["source"]] += r["taken"]
        largest[d["source"]] = max(largest[d["source"]], r["size"])
    for s in per:
        assert abs(taken[s] - target[s]) <= largest[s] + 1
    assert sum(taken.values()) <= 1.5 * sum(per.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, q.op9_source_mixing(spark, sf).collect()))


def test_op9_order_and_cut_equal_brute_force(spark, documents):
    """Virtual finish times, their order and the cut at the budget, served one by one; hashes are Spark's."""
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()] + [(3, "a third of all rows", "web")] * 60 + [(9_000, "no source here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = docs.select("doc_id", "source", "text", *row_keys("doc_id", "source", "text")).distinct()
    many = Counter(rows)
    hashed = hashed.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(60)).cast("array<bigint>"))).withColumn("h", F.xxhash64(F.lit(0), "_k1", "_k2", "i")).collect()
    served = [(r["source"], r["h"], r["_k1"], r["_k2"], r["i"], r["doc_id"], count_words(r["text"])) for r in hashed if r["i"] <= many[r["doc_id"], r["text"], r["source"]]]
    slices, per = max(16, -(-len(rows) // 20)), Counter()
    for s in served:
        per[s[0]] += s[-1]
    target, upto, copies = water_fill(per, (5, 2, 1), 1.5 * sum(per.values())), Counter(), []
    for source, h, k1, k2, i, d, size in sorted(served, key=lambda s: (s[1] % slices, *s[1:5])):
        upto[source] += size
        copies += [((c * per[source] + upto[source]) / target[source], source is None, source or "", h, k1, k2, i, c, d, size) for c in range(2)]
    total, want, budget = 0, Counter(), math.floor(1.5 * sum(per.values()))
    for c in sorted(copies):
        total += c[-1]
        if total <= budget:
            want[c[-2]] += c[-1]
    got = Counter()
    for r in mix(docs, slice_rows=20).collect():
        got[r["doc_id"]] += r["taken"]
    assert +got == +want


def test_op9_odd_rows(odd, none):
    rows = mix(odd).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["size"] == by[4]["size"] == by[5]["size"] == 0 and by[3]["taken"] == 0 and by[7]["size"] == 30_000 and by[8]["size"] == 120
    assert mix(none).count() == 0 and mixed_rows(none).count() == 0
    out = mixed_rows(odd)
    assert out.columns == odd.columns
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += r["taken"] // r["size"] if r["size"] else 0
    assert Counter(r["doc_id"] for r in out.collect()) == +want


def test_op9_sizes_match_the_word_rule(spark):
    from pointspark.llm.op9_mixing import word_count

    texts = [None, "", " ", "a", " a", "a ", " a  b\n", "\x0ba\x0c", "a b", "a\x1cb", "é\tü"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(word_count()).collect()]
    assert got == [count_words(t) for t in texts]


def plain_joined_chunks(spark, docs, window=2, divisor=4, least=2):
    """Chunks by the same rolling hash, short ones joined to a neighbour, the rest by dictionaries."""
    texts = [(d, t.split("\n")) for d, t in sorted(docs) if t is not None]
    grams_ = sorted({tuple(ls[i : i + window]) for _, ls in texts for i in range(len(ls) + 1 - window)})
    df = spark.createDataFrame([(list(g),) for g in grams_], "g array<string>").selectExpr("g", f"pmod(aggregate(g, 0L, (h, x) -> xxhash64(h, xxhash64(x))), {divisor}) = 0 e")
    ends = {tuple(r["g"]): r["e"] for r in df.collect()}
    first, out = {}, {}
    for d, ls in texts:
        cuts = [0]
        for i in range(window, len(ls)):
            if ends[tuple(ls[i - window : i])] and i - cuts[-1] >= least:
                cuts.append(i)
        if len(cuts) > 1 and len(ls) - cuts[-1] < least:
            cuts.pop()
        cuts.append(len(ls))
        chunks = [(a, tuple(ls[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert all(len(c) >= least for _, c in chunks) or len(ls) < least
        out[d] = "\n".join(x for a, c in chunks if len(c) < least or first.setdefault(c, (d, a)) == (d, a) for x in c)
    return out


def test_op10_equals_brute_force_of_joined_chunks(spark, documents):
    docs = texts_of(documents)
    got = dict(texts_of(dedup_lines(documents.select("doc_id", "text"))))
    assert got == plain_joined_chunks(spark, docs) and any(got[d] != t for d, t in docs)


def test_op10_copies_leave_no_line(spark):
    texts = ["\n".join(f"line {i} of text {t}" for i in range(2 + t % 20)) for t in range(200)]
    docs = spark.createDataFrame([(k * 200 + t, x) for k in range(2) for t, x in enumerate(texts)], "doc_id long, text string")
    got = dedup_lines(docs).collect()
    assert all(r["text"] == (texts[r["doc_id"]] if r["doc_id"] < 200 else "") for r in got)


def test_op10_odd_rows(odd, none):
    out = dedup_lines(odd)
    assert set(odd.columns) | {"n_removed"} == set(out.columns)
    rows = out.collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and by[3]["text"] is None and by[3]["n_lines"] == 0
    assert by[4]["text"] == "" and by[4]["n_lines"] == 1 and by[1]["n_removed"] == 0
    assert by[2]["n_removed"] == by[None]["n_removed"] == 4
    assert dedup_lines(none).count() == 0


def test_op10_long_text(spark):
    """Twenty thousand lines: the work on a text follows its length."""
    rng = np.random.default_rng(3)
    own = [f"line {i} {int(rng.integers(0, 10**9))}" for i in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(own)), (2, "\n".join(["first", *own[5_000:15_000], "last"])), (3, "a\nb\n" * 10_000)], "doc_id long, text string")
    by = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert by[1]["n_removed"] == 0 and by[2]["n_removed"] >= 9_990 and by[3]["n_lines"] == 20_001


def test_op10_bounds_are_those_of_one_array(spark):
    """Bounds gathered in blocks equal bounds gathered one by one."""
    rows = [(list(map(int, np.random.default_rng(i).integers(0, 9, n))),) for i, n in enumerate([2, 3, 50, 700, 3000])]
    df = spark.createDataFrame(rows, "_h array<long>")
    got = df.selectExpr(f"{chunk_bounds(2, 4, 2, '_h')} a", f"{chunk_bounds(2, 4, 2, '_h', 7)} b", f"{chunk_bounds(2, 4, 5, '_h', 3)} c", f"{chunk_bounds(2, 4, 5, '_h', 10_000)} d").collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got)
    assert all(np.diff([0, *r["c"]]).min() >= 5 for r in got[2:])


def test_op10_boundaries_resist_shifts(spark):
    body = [f"line {i} of a shared passage" for i in range(400)]  # what is lost is the chunk at either end and single lines
    docs = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(["something new", *body, "other end"]))], "doc_id long, text string")
    by = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    assert by[1]["n_removed"] == 0 and by[2]["n_removed"] >= 340 and by[2]["text"].startswith("something new")


CLASHING = ["_row", "_id", "_k1", "_k2", "_cut", "_at", "_s", "_l", "_n", "_all", "_h", "_r", "_t", "_u", "_p", "_i", "_m", "_text", "_doc", "_lines", "_first", "_salt", "lang_pred", "score", "component_id", "taken", "size", "d1", "_r1", "_b"]


def test_clashing_columns_come_back_unchanged(spark, odd, sf):
    """Columns named like an operator's own: every operator and stage that carries rows gives them back."""
    import corpus_pipeline as p

    docs = odd.filter("doc_id is not null").withColumns({c: F.concat(F.lit(c + " "), F.col("doc_id")) for c in CLASHING})
    runs = [(remove_repeats, ()), (dedup_lines, ()), (keep_one_each, ()), (mixed_rows, ()), (lambda d: identify(d, learn(odd)), ("lang_pred", "score")), *((lambda d, f=f: f(spark, d, sf), ()) for _, f in p.STAGES[:-1])]
    for run, own in runs:
        out = run(docs)
        assert set(docs.columns) <= set(out.columns)
        rows = out.collect()
        assert rows and all(r[c] == f"{c} {r['doc_id']}" for r in rows for c in CLASHING if c not in own)
