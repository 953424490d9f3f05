"""Filter audit, tiered BPE and importance resampling against brute force and the library, and on odd tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from siltstone.llm import arrowtext as at
from siltstone.llm import audit, resample, tiered
from siltstone.llm.perfecthash import PerfectHash
from siltstone.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, part string, mask int, run string, rank string, fingerprint string, n_words string, bucket int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    """Nulls, empties, copies in one place and many, repeated rows and ids, long and strange texts, clashing names."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("alpha beta Gamma delta #tag e$ naïve 日本 😀 it's 12 x9").replace(" ", "") + rng.choice(["", "A", "s"]) + str(rng.randrange(50)) for _ in range(n))
    copy, long = prose(120), prose(40_000)
    texts = [None, "", " \n\t ", "one", "One", "ABC", copy, long, "a" * 5000, "  runs   of \n \n white　space ", "naïve 日本語 😀 ​\u0085\u001c", "<|endoftext|> it's", *(prose(n) for n in (19, 20, 99, 100, 101, 150, 300)), *[copy] * 60]
    rows = [(i, t, (None, "", "en", "de")[i % 4], "s", "p", 7, "r", "k", "f", "n", 1) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[14], (None, copy, "en", *rows[0][3:]), (None, "no id", None, *rows[0][3:])]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(3, None, 1), (None, 1, 1), (4, 1, None), (999, 1, 1)], "doc_id long, quality int, toxic int")


def masks(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t])
        out.append((i, lang or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


def audited(rows, labels):
    """By applying the filters one after the other, in every order."""
    good, toxic = ({i for i, *said in labels if i is not None and said[k] == 1} for k in (0, 1))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for _, p, _ in rows}:
            left = [(i, m) for i, p, m in rows if p == part]
            gone = []
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                lost, redundant = [x for x in left if x[1] & bit], [x for x in gone if x[1] & bit]
                left, gone = [x for x in left if not x[1] & bit], gone + lost
                shapley[part, f] += len(lost)
                unique = sum(p == part and m == bit for _, p, m in rows)
                out[part, order, step] = len(left), len(lost), len(redundant), unique, sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_masks_brute_force(spark, odd, monkeypatch):
    expected = Counter(masks(odd_rows()))
    assert len({m for _, _, m in expected}) > 6
    for parts in ("1", "4", "40"):  # with 40 ranges, copies of one text fill several of them
        monkeypatch.setattr(at, "SLICE_BYTES", 3000)
        was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", parts), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = Counter((r.doc_id, r.part, r.mask) for r in audit.failure_masks(Scratch(spark, "audit"), odd).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was[0]), spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])
        assert got == expected


def test_ranges_of_colliding_fingerprints():
    """Two texts with one fingerprint, cut anywhere into ranges by id: the edges settle what no range sees."""
    import pyarrow as pa

    rows = [(7, t, i) for i, t in enumerate("xyxyyxzzyx" * 3)] + [(9, "w", 40), (9, "w", 41)]
    for cuts in ([5], [1, 2, 3], [10, 20], list(range(1, 30))):
        open_, edges, got = [], [], {}
        for task, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            mine = sorted(rows[a:b])
            seen = audit._Range(task)
            for at_ in range(0, len(mine), 2):
                f, t, i = map(list, zip(*mine[at_ : at_ + 2], strict=True))
                batch = pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(t), pa.array(i, pa.int64()), pa.array(["p"] * len(f))], ["fingerprint", "text", "doc_id", "part"])
                for part, data, offsets in at.slices(batch):
                    open_ += seen.rows(part, data, offsets).to_pylist()
            edges += seen.edges().to_pylist()
        least = {}
        for e in edges:
            least[e["fingerprint"], e["text"]] = min(e["least"], least.get((e["fingerprint"], e["text"]), e["least"]))
        before = {(e["task"], e["run"]): least[e["fingerprint"], e["text"]] for e in edges}
        for r in open_:
            got[r["doc_id"]] = bool(r["mask"] & audit.COPY) or (r["run"] is not None and r["doc_id"] > before[r["task"], r["run"]])
        assert got == {i: any(t == u and j < i for _, u, j in rows) for _, t, i in rows}


def test_audit_brute_force(spark, odd, labels):
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.interaction_audit(spark, odd, labels).collect()}
    assert got == audited(masks(odd_rows()), [tuple(r) for r in labels.collect()])
    assert len(got) == 3 * 600 and any(v[4] for v in got.values()) and any(v[5] for v in got.values())


def test_audit_odd(spark, odd, empty, labels):
    assert audit.interaction_audit(spark, empty, labels).count() == 0
    rows = audit.interaction_audit(spark, odd, labels.limit(0)).collect()
    assert len(rows) == 1800 and {(r.good_lost, r.toxic_lost) for r in rows} == {(0, 0)}
    assert {sum(r.shapley for r in rows if (r.part, r.filter_order) == (p, "ABCDE")) % 120 for p in ("", "en", "de")} == {0}


@pytest.mark.parametrize(("query", "tables"), [(audit.op11_filter_audit, audit.ORACLE), (resample.op13_importance_resampling, resample.ORACLE)])
def test_sql(spark, sf, query, tables):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, expected = query(spark, sf), con.sql(tables)
    names = sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, con.sql(f"select {', '.join(names)} from expected").fetchall()))


# 12


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(tiered.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_tiered(rows, texts, library):
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest() == hashlib.sha256(text.encode()).hexdigest()


def test_tiered_odd(spark, odd, empty, library):
    rows = tiered.tiered_encode(spark, odd).collect()
    assert len(rows) == len(odd_rows()) and tiered.tiered_encode(spark, empty).count() == 0
    check_tiered([r for r in rows if r.doc_id is not None], {i: t for i, t, *_ in odd_rows() if i is not None}, library)
    kept = [r for r in tiered.tiered_encode(spark, odd, keep_ids=True).collect() if r.doc_id == 10]
    assert kept[0].ids == library.encode_ordinary(odd_rows()[10][1]) and bytes(kept[0].decoded).decode() == odd_rows()[10][1]


def test_tiered_tables(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = tiered.op12_tiered_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    check_tiered(rows, texts, library)


def test_tiers_random(library):
    """Random bytes of many scripts and white space; a memo that is emptied all the time changes nothing."""
    rng = random.Random(8)
    letters = "abcdeéßж日本語한😀'\"#0123 \n\t\r 　\u0085 -_" + "the ing tion " * 3
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)] + ["a" * 3000, "ab" * 2000, " " * 500, "日" * 700, "\n" * 50 + "x", "responsibilities internationalization"]
    for limit in (5, 100_000):
        codec = tiered.TieredCodec(tiered.rank_bytes(), limit)
        for t in texts:
            flat, _ = codec.encode([t])
            assert flat.tolist() == library.encode_ordinary(t) and codec.decode(flat.tolist()) == t.encode()
        assert codec.hits > 300 and codec.misses > 300


def test_first_tier_is_exact():
    ranks = tiered.RankFile(tiered.rank_bytes()).ranks
    tier = tiered.Tier(ranks)
    assert sorted(tier.ids.tolist()) == sorted(ranks.values())  # minimal: each slot has one string
    rng = random.Random(1)
    words = [*rng.sample(sorted(ranks), 3000), b"", *(bytes(rng.randrange(256) for _ in range(rng.randrange(1, 7))) for _ in range(3000)), *(w + b"~~" for w in rng.sample(sorted(ranks), 500))]
    found, ids = tier.find(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    assert [int(i) if f else None for f, i in zip(found, ids, strict=True)] == [ranks.get(w) for w in words]
    for n in (0, 1, 2, 3, 17, 1000):
        keys = at.mix(np.arange(n, dtype=np.uint64) * np.uint64(77) + np.uint64(5))
        assert sorted(PerfectHash(keys).slots(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        PerfectHash(np.array([4, 4], np.uint64))


# 13


def drawn(rows, target, n=1, buckets=10_000, least=20, percent=10, seed=2024):
    def of(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]

    docs = [(i, *of(t)) for i, t, *_ in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in of(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, n_words, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(able):
        r.append(k + 1 if k < percent * len(able) // 100 else None)
    return Counter(tuple(r) if len(r) == 6 else (*r, None) for r in out)


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (3, 700, 60), (2, 100_000, 100)])
def test_resampling_brute_force(spark, odd, n, buckets, percent):
    target = ["one delta alpha 12 ¡Olé! x9", None, "", "gamma gamma Alpha"]
    wanted = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id int, text string, doc_id int")
    got = resample.resampled(spark, odd, wanted, n=n, buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    expected = drawn(odd_rows(), target, n, buckets, 20, percent)
    assert Counter(map(tuple, got.collect())) == expected and sum(v for k, v in expected.items() if k[5]) > 4


def test_resampling_odd(spark, odd, empty):
    assert resample.resampled(spark, empty, odd).count() == 0
    assert Counter(map(tuple, resample.resampled(spark, odd, empty).collect())) == drawn(odd_rows(), [])


def test_ring():
    rng = random.Random(2)
    for n in (1, 2, 5):
        text = " ".join(rng.choice("ab,Ç日-Z9") for _ in range(300)).encode()
        words = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
        assert sorted(resample.features(text, n)[1]) == sorted(zlib.crc32(b" ".join(words[i : i + k])) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words))
