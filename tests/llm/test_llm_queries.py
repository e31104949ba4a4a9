"""The registered queries at the smallest scale."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from catalog.check import rows_of
from speechprep.llm.queries import QUERIES
from speechprep.llm.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cursor = db.execute(SQL[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, df.collect()) == want and want[1]


def test_language_is_learned(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in QUERIES["op7_language_id"](spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, sizes = docs, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, first, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        first = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(first.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    texts = [r.text for r in spark.read.parquet(str(tmp_path / "2")).collect()]
    assert len(texts) == len(set(texts))
    encoded = corpus_pipeline.STAGES[-1][1](spark, first, SF).collect()
    assert len(encoded) == sizes[4] and all(r.round_trip for r in encoded)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64(" ".join(words[k : k + size]).encode(), seed=42).intdigest() for k in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(marks):
    root = {k: k for k in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in marks:
        for b in marks:
            if a < b and (marks[a] ^ marks[b]).bit_count() <= 4:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in marks}


def brute_mix(sizes, source):
    """Copies of each document: expected copies summed in order of size, emitted at whole numbers."""
    total = Counter()
    for k, n in sizes.items():
        total[source[k]] += n
    order = sorted(total)
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    capped = {}
    while True:
        left = sum(total.values()) - sum(capped.values())
        unit = left / max(1e-300, sum(weight[s] for s in order if s not in capped))
        new = {s: 3 * total[s] for s in order if s not in capped and 3 * total[s] <= unit * weight[s]}
        if not new:
            break
        capped |= new
    out = {}
    for s in order:
        target = capped.get(s, unit * weight[s])
        rate = round(target / total[s] * 2**24) if total[s] else 0
        at = int(hashlib.md5(f"mix:s:{s}".encode()).hexdigest()[:6], 16)
        for k in sorted((k for k in sizes if source[k] == s), key=lambda k: (sizes[k], k)):
            out[k] = (at + rate >> 24) - (at >> 24)
            at += rate
    return out


def test_pipeline_equals_brute_force(spark):
    """All stages after the classifier, whose fit is tested by itself, in plain Python on the selected documents."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in QUERIES["op5_quality_classifier"](spark, SF).collect() if r.selected}
    same = defaultdict(list)
    for k in good:
        same[re.sub(r"[\x20\x09-\x0D]+", " ", rows[k].text or "")].append(k)
    single = {min(ids) for ids in same.values()}
    group = brute_groups({k: brute_fingerprint(rows[k].text or "") for k in single})
    left = {k for k in single if group[k] == k}
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", rows[k].text or "")) for k in left}
    copies = brute_mix(sizes, {k: rows[k].source for k in left})
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = Counter({(k, tuple(library.encode(rows[k].text or ""))): n for k, n in copies.items() if n})
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(rows) > len(good) >= len(single) > len(left) > 50
