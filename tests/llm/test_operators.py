"""Each operator on small hand-made tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
import xxhash

import corpus_pipeline
from speechprep.llm import license_scan as licences
from speechprep.llm import pieces as sp
from speechprep.llm import token_counts as bpe
from speechprep.llm.components import components
from speechprep.llm.exact_dedup import drop_exact_copies, exact_dedup
from speechprep.llm import language_id as languages
from speechprep.llm.language_id import _sample as sample_of_languages
from speechprep.llm.language_id import language_id
from speechprep.llm.mixing import mix_sources, mixed
from speechprep.llm.quality_classifier import _slopes as slopes
from speechprep.llm.quality_classifier import quality_classifier, select_quality
from speechprep.llm.quality_rules import fit_accuracies, good_given, posterior, quality_rules
from speechprep.llm.queries import QUERIES, graded
from speechprep.llm.sharding import shard_by_bytes
from speechprep.llm.simhash import drop_near_copies, fingerprint, near_links, simhash_groups
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, name string"
SPACES = r"[\x20\x09-\x0D]+"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, "en", s, 0, 7, "x", "y") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


rng = random.Random(4)
LONG = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randint(0, 99)) for _ in range(3000))
ROWS = [
    (1, "a b  c", "s1"), (2, "a\tb c", "s2"), (3, None, None), (4, "", "s1"), (5, " \n ", "s2"), (6, "a b c ", "s1"),
    (7, LONG, "s1"), (8, LONG.replace(" ", "\n", 5), "s2"), (9, LONG + "x", "s1"), (9, LONG + "x", "s1"),
    (None, "a b c", "s3"), (10, "ünï 漢字 🙂", None), (11, " ", "s3"), (12, LONG[:-1], "s3"),
]


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def normal(text):
    return re.sub(SPACES, " ", text or "")


def test_exact_dedup(table):
    got = exact_dedup(table, block_chars=64).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[normal(t)].append(i)
    want = Counter()
    for i, t, _ in ROWS:
        ids = groups[normal(t)]
        want[i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(normal(t).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = drop_exact_copies(table).collect()
    assert len(kept) == len(groups) and set(kept[0].asDict()) == set(table.columns)


def test_exact_dedup_finds_one_changed_character_in_any_block(spark):
    base = "abcdefgh" * 40
    rows = [(0, base, "s")] + [(k + 1, base[:k] + "!" + base[k + 1 :], "s") for k in range(0, 320, 7)] + [(999, base, "s")]
    got = {r.doc_id: r.keep_id for r in exact_dedup(docs(spark, rows), block_chars=16).collect()}
    assert got[999] == 0 and all(got[i] == i for i in got if i != 999)


def test_hot_group_of_copies(spark):
    rows = [(k, "same text " * 30, "s") for k in range(300)] + [(1000 + k, f"other {k}", "s") for k in range(50)]
    got = exact_dedup(docs(spark, rows), block_chars=32).collect()
    assert {r.group_size for r in got if r.doc_id < 1000} == {300} and sum(r.kept for r in got) == 51


def test_sharding(table, spark):
    got = shard_by_bytes(table, 4).collect()
    total = sum(r.size for r in got)
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 1 for _, t, _ in ROWS)
    assert Counter(r.text_crc32 for r in got) == Counter(zlib.crc32((t or "").encode()) for _, t, _ in ROWS)
    for shard in range(4):
        own = sorted(r.slot for r in got if r.shard == shard)
        assert own == list(range(len(own)))
    many = docs(spark, [(k, "x" * (k % 50), "s") for k in range(400)])
    rows = shard_by_bytes(many, 8).collect()
    sizes, ends = Counter(), {}
    for r in rows:
        sizes[r.shard] += r.size
        low, high = ends.get(r.shard, (r.doc_id, r.doc_id))
        ends[r.shard] = (min(low, r.doc_id), max(high, r.doc_id))
    assert max(sizes.values()) - min(sizes.values()) <= 51 and total
    assert all(ends[k][1] < ends[k + 1][0] for k in range(7))


def water(sizes, weights):
    left, capped = sum(sizes.values()), {}
    while True:
        unit = (left - sum(capped.values())) / max(1e-300, sum(weights[s] for s in sizes if s not in capped))
        new = {s: 3 * sizes[s] for s in sizes if s not in capped and 3 * sizes[s] <= unit * weights[s]}
        if not new:
            return {s: capped.get(s, unit * weights[s]) for s in sizes}
        capped |= new


def test_mixing(spark):
    rows = [(k, "w " * (k % 40), ["b", "a", "c", None, "é"][min(k % 7, 4)]) for k in range(700)]
    rows += [(5000 + k, "w " * 3, "tiny") for k in range(4)] + [(None, None, "a"), (6000, "", "none")]
    df = docs(spark, rows)
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.copies in range(4)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3 * 40
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    again = {(r.doc_id, r.source): r.taken for r in mix_sources(df).collect() if r.doc_id is not None}
    assert all(again[r.doc_id, r.source] == r.taken for r in got if r.doc_id is not None)
    emitted = mixed(df)
    assert emitted.columns == df.columns
    assert emitted.count() == sum(r.copies for r in got)


def test_mixing_repeated_rows(spark):
    df = docs(spark, [(1, "a b c", "s")] * 5 + [(2, "a", "s")])
    assert mixed(df).count() == sum(r.copies for r in mix_sources(df).collect())


def brute_counts(t):
    w = [x for x in re.split(SPACES, t or "") if x]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, table):
    r = random.Random(2)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 30))) for _ in range(60)]
    texts += ["a b c d e " * 3, "x\nx\n\n x\nx", "|#*$%&<>" * 4, "WORD!! " * 30, "Some clean words, nothing wrong with them at all today."]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(500 + k, t, s) for k, (_, t, s) in enumerate(ROWS)]
    got = {x.doc_id: x for x in quality_rules(docs(spark, rows)).collect()}
    for k, t, _ in rows:
        x = got[k]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_counts(t), t
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert not (x.kept and x.base_failed) and 0 <= x.p_good <= 1
    assert got[len(texts) - 1].kept


def test_accuracies_follow_agreement():
    patterns = [{"a": 1, "b": 1, "c": 1, "n": 80}, {"a": 0, "b": 0, "c": 0, "n": 15}, {"a": 1, "b": 1, "c": 0, "n": 30}]
    fitted, prior = fit_accuracies(patterns, ["a", "b", "c"])
    assert fitted["a"] == fitted["b"] > fitted["c"] and 0.8 < prior < 0.95
    assert fit_accuracies([], ["a"]) == ({"a": 0.9}, 0.5)


def test_posterior_equals_enumeration(spark):
    """Each class, weighed by the chance of all votes under it."""
    accuracy, prior = {"a": 0.9, "b": 0.7, "c": 0.6}, 0.8
    patterns = [dict(zip("abc", votes)) for votes in product((-1, 0, 1), repeat=3)]
    frame = spark.createDataFrame([tuple(p.values()) for p in patterns], "a int, b int, c int")
    got = [r.p for r in frame.select(posterior(accuracy, prior).alias("p")).collect()]
    for pattern, p in zip(patterns, got):
        chance = {1: prior, 0: 1 - prior}
        for truth in chance:
            for rule, vote in pattern.items():
                if vote >= 0:
                    chance[truth] *= accuracy[rule] if vote == truth else 1 - accuracy[rule]
        want = chance[1] / (chance[0] + chance[1])
        assert abs(p - want) < 1e-12 and abs(good_given(pattern, accuracy, prior) - want) < 1e-12


@pytest.mark.parametrize("prior", [0.3, 0.85])
def test_shares_and_accuracies_are_found_again(prior):
    r = random.Random(4)
    true = {"a": 0.95, "b": 0.85, "c": 0.75, "d": 0.7}
    counts = Counter()
    for _ in range(60_000):
        good = r.random() < prior
        counts[tuple(-1 if r.random() < 0.3 else int(good == (r.random() < a)) for a in true.values())] += 1
    patterns = [dict(zip(true, votes), n=n) for votes, n in counts.items()]
    fitted, share = fit_accuracies(patterns, list(true), rounds=300)
    assert abs(share - prior) < 0.03 and all(abs(fitted[k] - true[k]) < 0.04 for k in true)


def test_token_counts(spark, table):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    r = random.Random(1)
    alphabet = ["a", "B", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\xa0", "é", "ß", "1", "½", "!", "<|endoftext|>", "漢", "🙂", "\r\n", "the", "ing", "\x85"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(800)] + ["a" * 5000, LONG]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(10_000, None, "s")]
    got = {x.doc_id: x for x in bpe.token_counts(docs(spark, rows), Path(path).read_text()).collect()}
    for k, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 1024), t


def brute_fingerprint(t):
    w = [x for x in re.split(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, table):
    for _, t, _ in ROWS:
        assert fingerprint(t) == brute_fingerprint(t)
    got = simhash_groups(table).collect()
    marks = sorted({fingerprint(t) for _, t, _ in ROWS})
    group = {m: {x for x in marks if (x ^ m).bit_count() <= 4} for m in marks}
    for _ in marks:
        group = {m: set().union(*(group[x] for x in g)) for m, g in group.items()}
    for r in got:
        reach = group[r.fp & (2**64 - 1)]
        assert r.component_id == min(i for i, t, _ in ROWS if i is not None and fingerprint(t) in reach)
    kept = drop_near_copies(table)
    assert kept.columns == table.columns
    assert kept.count() == len({frozenset(g) for g in group.values()})


CLASHING = [
    "row", "at", "file", "place", "o", "key", "text_hash", "copies", "col", "norm", "uid", "blocks", "block", "h", "name",
    "kept", "fp", "root", "first", "component_id", "size", "idx", "target", "taken", "sha_", "rows_", "copies_", "times_",
    "copy_", "stays_", "_metadata", "part_", "bucket", "level",
]


@pytest.mark.parametrize("stage", [drop_exact_copies, drop_near_copies, mixed])
def test_stages_keep_columns_of_any_name(spark, table, stage, tmp_path):
    """Also read from files; each row keeps its own values."""
    clashing = table.select("doc_id", "text", "source", *[F.coalesce("doc_id", F.lit(-5)).alias(c) for c in CLASHING])
    clashing.drop("_metadata").write.parquet(str(tmp_path / "docs"))
    written = spark.read.parquet(str(tmp_path / "docs"))
    plain = Counter((r.doc_id, r.text, r.source) for r in stage(table.select("doc_id", "text", "source")).collect())
    for df in (clashing, written):
        out = stage(df)
        assert out.columns == df.columns
        rows = out.collect()
        assert sum(plain.values()) == len(rows)
        assert all(set(r[3:]) == {-5 if r.doc_id is None else r.doc_id} for r in rows)


@pytest.mark.parametrize("stage", [drop_exact_copies, drop_near_copies, mixed])
def test_whole_rows_are_shuffled_once(spark, tmp_path, stage):
    """The plan that gives whole rows back has one exchange that holds texts."""
    rows = [(k, f"text number {k} " * 20, f"s{k % 3}") for k in range(200)]
    docs(spark, rows).write.parquet(str(tmp_path / "docs"))
    out = stage(spark.read.parquet(str(tmp_path / "docs")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ShuffledHashJoin") == 1
    assert plan.count("FileScan parquet") == 2 and "SortMergeJoin" not in plan and "Sort " not in plan


def test_links_of_a_crowded_ball_in_small_slices(spark):
    r = random.Random(3)
    marks = {r.getrandbits(64) for _ in range(40)}
    for m in list(marks)[:20]:
        for _ in range(12):
            for b in r.sample(range(64), r.randint(1, 6)):
                m ^= 1 << b
            marks.add(m)
    signed = [(int(np.uint64(m).astype(np.int64)),) for m in marks]
    links = near_links(spark.createDataFrame(signed, "fp long"), at_once=20_000)
    got = {x.node: x.root for x in components(links).collect()}
    parent = {m[0]: m[0] for m in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a,) in signed:
        for (b,) in signed:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    assert {m: got.get(m, m) for (m,) in signed} == {m: find(m) for (m,) in signed}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(1000, 1001 + k) for k in range(200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(61), 0) | dict.fromkeys(range(1000, 1201), 1000)


def test_language_id(spark, empty):
    r = random.Random(5)
    letters = {"xx": "abcde ", "yy": "vwxyz ", "zz": "éàüöß "}
    rows = []
    for k in range(240):
        lang = "xyz"[k % 3] * 2
        rows.append((k, "".join(r.choice(letters[lang]) for _ in range(80)), lang))
    schema = "doc_id long, text string, lang string, score string"
    extra = [(1000, None, "xx"), (1001, "123 !", "yy"), (1002, "", None), (1003, "abcabc", None), (None, "abcab", "xx")]
    df = spark.createDataFrame([(*x, "extra") for x in rows + extra], schema)
    got = {x.doc_id: x for x in language_id(df, F.col("doc_id") % 4 != 1).collect()}
    assert len(got) == 245
    assert all(got[k].lang_pred == lang for k, _, lang in rows)
    assert [got[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "xx"]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in language_id(df, F.lit(False)).collect()} == {"und"}


def test_weights_are_sparse(spark):
    """Most are zero, the kept-out rows lose next to nothing by it, and sparse rows give the dense logits."""
    r = random.Random(2)
    rows = [(k, " ".join("".join(r.choice(a) for _ in range(6)) for _ in range(30)), k % 3) for k in range(300)
            for a in [("abcdefgh", "cdefghijk", "efghijklm")[k % 3]]]
    samples = []
    for _, t, y in rows:
        used, counts = languages._grams(t)
        values = 1 + np.log(counts)
        samples.append((used, values / np.sqrt(values @ values), y))
    found = languages.fit_languages(samples, 3)
    touched = len(np.unique(np.concatenate([u for u, _, _ in samples]))) * 3
    assert len(found.weights) < 0.5 * touched
    assert np.mean([found.logits(u, v).argmax() == y for u, v, y in samples]) > 0.95
    dense = np.where(np.random.default_rng(1).random((50, 4)) < 0.3, np.random.default_rng(2).standard_normal((50, 4)), 0)
    sparse = languages.SparseRows(dense)
    for used in (np.array([0, 3, 49]), np.arange(50), np.zeros(0, np.int64)):
        values = np.linspace(-1, 2, len(used))
        assert np.allclose(sparse.logits(used, values), values @ dense[used])


def test_language_id_fits_every_language_and_a_shared_id_once(spark):
    r = random.Random(15)
    rows = [
        (300 * k + n, "".join(chr(0x4E00 + 20 * n + r.randrange(20)) for _ in range(40)), f"l{n:03}")
        for n in range(270) for k in range(4)
    ]
    df = spark.createDataFrame(rows + [(5, rows[20][1], "l005")] * 500, "doc_id long, text string, lang string")
    assert sample_of_languages(df, 800).count() <= len(rows) + 1
    got = language_id(df, F.lit(True)).select("lang_pred").distinct().count()
    assert got > 256


def test_slopes_of_the_likelihood():
    """Against differences of log P(grade)."""
    cuts, step = np.array([-0.7, 0.2, 1.1]), 1e-6

    def log_p(score, cuts, grade):
        above = np.concatenate([[1.0], 1 / (1 + np.exp(-(score - cuts))), [0.0]])
        return np.log(above[grade] - above[grade + 1]), above

    for score in (-2.0, 0.1, 1.5):
        for grade in range(4):
            _, above = log_p(score, cuts, grade)
            by_score, by_cut = slopes(above, grade)
            up, down = (log_p(score + d, cuts, grade)[0] for d in (step, -step))
            assert abs((up - down) / (2 * step) - by_score) < 1e-5
            for k in range(3):
                up, down = (log_p(score, cuts + d * np.eye(3)[k], grade)[0] for d in (step, -step))
                assert abs((up - down) / (2 * step) - by_cut[k]) < 1e-5


@pytest.mark.parametrize("per_grade", [190, 1500])
def test_probabilities_are_those_of_all_rows(spark, per_grade):
    """However many texts of a grade are fitted: mean tails are the shares among rows that the fit has not seen."""
    sf = "/root/testdata/sf0.1"
    rated = graded(spark.read.parquet(f"{sf}/labels.parquet")).dropna()
    fitted, held = rated.filter("doc_id % 2 = 0"), rated.filter("doc_id % 2 = 1")
    found = quality_classifier(spark.read.parquet(f"{sf}/documents.parquet"), fitted, per_grade=per_grade).join(held, "doc_id")
    row = found.agg(
        *[F.avg(F.get("tail", F.lit(k - 1))).alias(f"p{k}") for k in (1, 2)],
        *[F.avg((F.col("grade") >= k).cast("int")).alias(f"s{k}") for k in (1, 2)], F.count("*").alias("n"),
    ).first()
    assert row.n > 1000 and abs(row.p1 - row.s1) < 0.02 and abs(row.p2 - row.s2) < 0.02, row


def test_quality_classifier(spark):
    r = random.Random(6)

    def text(grade):
        words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        marks = {0: "%%%", 1: "", 2: ""}[grade]
        return " ".join(w + marks for w in words) + (" clown idiot" * 4 if grade == 1 else "")

    rows = [(k, text(k % 3), "s") for k in range(240)] + [(900, None, "s"), (None, text(0), "s"), (901, "", None)]
    df = docs(spark, rows)
    ratings = spark.createDataFrame([(k, k % 3) for k in range(0, 240, 2)] + [(None, 1), (7, None)], "doc_id long, grade int")
    got = {x.doc_id: x for x in quality_classifier(df, ratings).collect()}
    held = [k for k in range(1, 240, 2)]
    assert sum(got[k].selected == (k % 3 > 0) for k in held) >= 0.95 * len(held)
    assert all(1 >= x.tail[0] >= x.tail[1] >= 0 and abs(sum(x.tail) - x.expected_grade) < 1e-9 for x in got.values())
    kept = select_quality(df, ratings)
    assert kept.columns == df.columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(x.doc_id for x in got.values() if x.selected)
    assert all(x.selected for x in quality_classifier(df, ratings.filter("grade = 1")).collect())


def test_license_scan(spark, table):
    notice = licences.NOTICES["MIT"]
    changed = notice.replace("free of charge", "at no cost").replace("sublicense", "sub-license")
    rows = [
        (1, "intro words. " + licences.NOTICES["MIT-line"] + " more", "s"), (2, LONG + "\n" + notice + "\n" + LONG, "s"),
        (3, changed, "s"), (4, None, "s"), (5, "", "s"), (6, "Licensed under nothing.", "s"),
        (7, (licences.NOTICES["CC-BY-NC-4.0-line"] + " filler here. ") * 3, "s"), (8, notice[: len(notice) // 2], "s"),
    ]
    texts = {i: t for i, t, _ in rows}
    got = defaultdict(list)
    for r in licences.license_scan(docs(spark, rows), licences.notices(spark)).collect():
        got[r.doc_id].append(r)
    assert [(r.license, r.coverage) for r in got[1]] == [("MIT-line", 1.0)]
    assert texts[1][got[1][0].start : got[1][0].end] == "Released under the MIT License"
    assert [(r.license, r.coverage) for r in got[2]] == [("MIT", 1.0)] and len(got[2][0].spans) == 1
    assert got[3][0].license == "MIT" and 0.8 < got[3][0].coverage < 1 and len(got[3][0].spans) > 1
    assert [r.license for r in got[7]] == ["CC-BY-NC-4.0-line"] * 3
    assert not {4, 5, 6, 8} & set(got)


def test_whole_licences_are_told_apart():
    index = licences.Index(list(licences.NOTICES.items()))
    assert len(licences.NOTICES) <= licences.MOST_TEMPLATES
    for name, text in licences.NOTICES.items():
        found = licences.scan("before it\n" + text + "\nafter it", index)
        assert [(m["license"], m["coverage"]) for m in found] == [(name, 1.0)], (name, found)
    first = licences.NOTICES["MIT"].split("\n\n")[0]  # the first paragraph alone is not the licence
    assert "MIT" not in {m["license"] for m in licences.scan(first, index)}
    found = licences.scan("Copyright 2001. All rights reserved.\n\n" + licences.NOTICES["BSD-4-Clause"], index)
    assert [m["license"] for m in found] == ["all-rights-reserved", "BSD-4-Clause"]
    changed = licences.NOTICES["GPL-3.0"].split()
    changed[3000:3000] = ["inserted"] * 20
    del changed[1000:1050]
    found = [m for m in licences.scan(" ".join(changed), index) if m["license"] == "GPL-3.0"]
    assert len(found) == 1 and found[0]["coverage"] > 0.98


def test_licences_are_found_however_they_were_changed():
    """Words missing, changed or put in, spread as far as the threshold allows, or a block of words put in at one place."""
    r = random.Random(7)
    index = licences.Index(list(licences.NOTICES.items()))
    new = lambda: f"zz{r.randrange(10**6)}"
    asked, found, named = 0, 0, 0
    for name, text in licences.NOTICES.items():
        w = licences.words(text)
        cases = []
        for how in ("missing", "changed", "put in", "mixed"):
            rate = r.choice([0.1, 0.15, 0.19])
            lost = set(r.sample(range(len(w)), int(len(w) * rate)))
            out = []
            for k, x in enumerate(w):
                kind = r.choice(["missing", "changed", "put in"]) if how == "mixed" else how
                out += [x] if k not in lost else {"missing": [], "changed": [new()], "put in": [x, new()]}[kind]
            cases.append(out)
        for size in (5, 30, 200):
            at = r.randrange(1, len(w))
            cases.append(w[:at] + [new() for _ in range(min(size, 2 * len(w)))] + w[at:])
        for words in cases[:: 1 if len(w) < 1500 else 3]:
            got = licences.scan(" ".join([new() for _ in range(20)] + words + [new() for _ in range(20)]), index)
            asked, found = asked + 1, found + bool(got)
            named += any(m["license"] == name for m in got)
    assert found >= 0.99 * asked and named >= 0.9 * asked, (asked, found, named)


def test_chains_leave_the_diagonal_at_a_price():
    hits = [(10 + k, k) for k in range(5)] + [(40 + k, 5 + k) for k in range(5)]  # a block of 25 words put in
    hits += [(300 + k, k) for k in range(10)] + [(12, 9), (41, 0)]
    found = sorted(map(len, licences.chains(np.array(sorted(hits)), 64)))
    assert found == [1, 1, 10, 10]


def test_any_word_of_a_short_notice_may_be_missing_or_changed():
    found = licences.scan("Released under MIT License.", licences.Index([("MIT-line", licences.NOTICES["MIT-line"])]))
    assert [(m["license"], m["coverage"]) for m in found] == [("MIT-line", 0.8)]
    r = random.Random(9)
    lines = [t for t in licences.NOTICES.values() if len(licences.words(t)) <= 20]
    lines += [" ".join(r.choice("abcdefghij") for _ in range(n)) for n in range(5, 40)]
    for line in lines:
        index, w = licences.Index([("x", line)]), licences.words(line)
        for k in range(len(w)):
            for changed in (w[:k] + w[k + 1 :], [*w[:k], "changed", *w[k + 1 :]]):
                text = " ".join(["before", "it", *changed, "and", "after"])
                assert bool(licences.scan(text, index)) == (len(w) >= 5), (line, text)
        most = len(w) - -(-4 * len(w) // 5)
        for _ in range(20):  # as many as the threshold allows
            lost = set(r.sample(range(len(w)), most))
            assert licences.scan(" ".join("changed" if k in lost else x for k, x in enumerate(w)), index), (line, lost)


def test_alignment_against_brute_force():
    r = random.Random(8)
    for _ in range(150):
        template = np.array([r.randint(1, 6) for _ in range(12)])
        text = list(template)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(text))
            text[at : at + 1] = r.choice([[], [0], [text[at], 0]])
        before = [0] * r.randint(0, 5)
        rows = np.arange(13) + len(before)
        places = licences.align(template, np.array(before + text + [0] * 3), rows - 8, rows + 8)
        assert all(template[i] == (before + text)[at] for i, at in places)
        table = np.zeros((13, len(text) + 1), int)
        for i in range(12):
            for j in range(len(text)):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (template[i] == text[j]))
        assert table[-1, -1] - 1 <= len(places) <= table[-1, -1]


@pytest.fixture(scope="module")
def model():
    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def test_pieces(spark, table, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    r = random.Random(3)
    alphabet = "aabcdelmnorstuéÉß.,!?-_ooo000 11=//###...|  \n漢🙂"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 16))) for _ in range(500)]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(900 + k, t, s) for k, (_, t, s) in enumerate(ROWS)]
    df = docs(spark, rows)
    ids = sp.encode(df, model, most=50)
    got = {x.doc_id: x.ids for x in ids.collect()}
    for k, t, _ in rows:
        assert got[k] == library.encode(t or ""), t
    back = {x.doc_id: x.text for x in sp.decode_ids(ids, model).collect()}
    assert all(back[k] == (t or "") for k, t, _ in rows)
    digest = {x.doc_id: x for x in sp.encode_digest(df, model).collect()}
    for k, t, _ in rows:
        packed = np.array(got[k], "<i4").tobytes()
        assert (digest[k].n_pieces, digest[k].ids_crc32, digest[k].round_trip) == (len(got[k]), zlib.crc32(packed), True)


def test_registered_encoding_gives_the_ids(spark, model, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs(spark, ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    last = corpus_pipeline.STAGES[-1][1](spark, docs(spark, ROWS), str(tmp_path)).collect()
    for found in (QUERIES["op3_sentencepiece"](spark, str(tmp_path)).collect(), last):
        assert Counter((x.doc_id, tuple(x.ids)) for x in found) == Counter((i, tuple(library.encode(t or ""))) for i, t, _ in ROWS)
        assert all(x.n_pieces == len(x.ids) for x in found)


def test_lattice_equals_fold(spark, model):
    tables = sp.Pieces(model)
    words = ["▁the", "▁...", ",$$$", "▁▁▁a", "漢🙂", "▁ouithrandly", "aaaa", "▁"]
    got = {r.word: r.codes for r in sp.lattice_encode(spark.createDataFrame([(w,) for w in words], "word string"), tables).collect()}
    assert got == {w: sp.fold(tables, w) for w in words}


def test_units_folded_together_equal_the_fold(model, monkeypatch):
    """All pieces beside each other, unknown characters, equal scores and too many edges; few units, and all, at once."""
    tables = sp.Pieces(model)
    r = random.Random(12)
    pieces, known = list(tables.table), sorted({c for piece in tables.table for c in piece})
    units = ["".join(r.choice(pieces) for _ in range(r.randint(1, 9)))[:52] for _ in range(3000)]
    units += ["".join(r.choice(known) if r.random() < 0.8 else r.choice("aeio漢🙂\x00") for _ in range(r.randint(1, 50))) for _ in range(1500)]
    units = list({*units, *pieces[:3000], *(c * k for c in "a▁=é" for k in range(1, 50)), "andthe" * 8, "\n"})
    expected = {unit: sp.pack(tables, sp.fold(tables, unit)) for unit in units}
    assert sp.fold_all(tables, units) == expected
    monkeypatch.setattr(sp, "FOLDED", 100)
    assert sp.fold_all(tables, units[:300]) == {unit: expected[unit] for unit in units[:300]}


def test_unknown_units_of_texts_are_folded_together(model, monkeypatch):
    tables, calls = sp.Pieces(model), []
    reader, encoder = sentencepiece.SentencePieceProcessor(model_proto=model), sp.Encoder(tables, {})
    folded = sp.fold_all
    monkeypatch.setattr(sp, "fold_all", lambda *args: calls.append(1) or folded(*args))
    monkeypatch.setattr(sp, "fold", lambda *args: calls.append("alone"))
    texts = ["Thretist, onhationble antibleble.", "", "ershthwh\n\nThretist", "漢 ershthwh"]
    assert [np.frombuffer(p, "<i4").tolist() for p in encoder.encode_all(texts)] == [reader.encode(t) for t in texts]
    assert calls == [1]


def test_mark_is_a_space(model):
    reader, encoder = sentencepiece.SentencePieceProcessor(model_proto=model), sp.Encoder(sp.Pieces(model), {})
    r = random.Random(31)
    for _ in range(4000):
        text = "".join(r.choice("▁▁ ab.\n1é漢") for _ in range(r.randint(1, 9)))
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == reader.encode(text), text


def test_bounded_memories_give_the_same(spark, model, monkeypatch):
    monkeypatch.setattr(sp, "UNIT_BYTES", 2000)
    monkeypatch.setattr(sp, "OUT_BYTES", 500)
    reader, encoder = sentencepiece.SentencePieceProcessor(model_proto=model), sp.Encoder(sp.Pieces(model), {})
    r = random.Random(5)
    text = " ".join("".join(r.choice("abcdeo") for _ in range(r.randint(1, 7))) for _ in range(600))
    assert np.frombuffer(encoder.encode(text), "<i4").tolist() == reader.encode(text)
    assert len(encoder) + len(encoder.older) < 20
    rows = [(k, text[k : k + 40 * k], "s") for k in range(60)]
    got = {x.doc_id: x.ids for x in sp.encode(docs(spark, rows), model).collect()}
    assert got == {k: reader.encode(t) for k, t, _ in rows}


def test_words_have_the_units_of_the_text(spark, model, monkeypatch):
    """Texts are cut at spaces and line breaks; a distinct word is cut into units once, and only so many are remembered."""
    monkeypatch.setattr(sp, "JOINED", 8)
    monkeypatch.setattr(sp, "COUNTED", 30)
    monkeypatch.setattr(sp, "SENT_CHARS", 6)
    units = sp.Pieces(model).units
    reader, encoder = sentencepiece.SentencePieceProcessor(model_proto=model), sp.Encoder(sp.Pieces(model), {})
    r = random.Random(8)
    texts = ["", " ", "\n", "a\n", "\n\na b", "a  b", " a", "a,b▁ c"]
    texts += ["".join(r.choice("abcé,.1 \n" + "  ▁" * (k % 2)) for _ in range(r.randint(1, 30))) for k in range(400)]
    for text in texts:
        assert [u for w in sp.split_words(text, units) for u in units.findall(w)] == sp.split_units(text, units), text
        assert np.frombuffer(encoder.encode(text), "<i4").tolist() == reader.encode(text), text
        assert len(encoder.joined) <= 8 and all(w in encoder for w in encoder.joined)
    counted = Counter(u for t in texts for u in sp.split_units(t, units) if len(u) <= 6)
    df = docs(spark, [(k, t, "s") for k, t in enumerate([*texts, None])]).repartition(2)
    assert {x.word: x.n for x in sp.unit_counts(df, units).collect()} == counted


def test_mark_itself_does_not_come_back(spark, model):
    assert not sp.encode_digest(docs(spark, [(1, "a▁b", "s")]), model).first().round_trip


def test_empty_tables(spark, empty, model):
    ratings = spark.createDataFrame([], "doc_id long, grade int")
    vocabulary = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    for out in (
        exact_dedup(empty), drop_exact_copies(empty), licences.license_scan(empty, licences.notices(spark)),
        sp.encode_digest(empty, model), shard_by_bytes(empty, 3), quality_classifier(empty, ratings),
        select_quality(empty, ratings), bpe.token_counts(empty, vocabulary), language_id(empty, F.lit(True)),
        simhash_groups(empty), drop_near_copies(empty), quality_rules(empty), mix_sources(empty), mixed(empty),
    ):
        assert out.count() == 0


def test_units_are_crossed_by_no_piece(model):
    assert sp.unit_pattern(["ab", "▁a", "...", "▁"]).findall("▁ab²..c_1\n▁▁") == ["▁ab²", "..", "c", "_1", "\n", "▁▁"]
    assert sp.unit_pattern(["ab", "²."]).findall("▁ab²..c") == ["▁ab", "²..", "c"]  # the letter joins the rest
    assert sp.unit_pattern(["n't", "x"]).findall("don't x") == ["do", "n't ", "x"]
    tables = sp.Pieces(model)
    assert all(tables.units.findall(piece) == [piece] for piece in tables.table)
    reader, encoder = sp.sentencepiece.SentencePieceProcessor(model_proto=model), sp.Encoder(tables, {})
    for text in ("a▁b ▁ c", "x²., ².", "a  \n b\t c_d  ", "日本語です。abc123,4.5é", "​ ­'' 1st don't"):
        assert sp.np.frombuffer(encoder.encode(text), "<i4").tolist() == reader.encode(text), text
