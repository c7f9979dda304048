"""Phrases, SimHash and the manifest against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from skywindow.llm import merkle, phrases, simhash
from skywindow.llm.common import stash

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, (t, lang) in enumerate(rows)], DOC)


def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, clashing names."""
    rng = random.Random(5)
    long_text = " ".join(rng.choice("alna beri tus mo lek".split()) for _ in range(30_000))
    rows = [(1, "alna beri", "en", "a", 9), (1, "alna beri", "en", "a", 9), (None, None, None, None, None), (None, "x", None, "b", 1), (2, "", "en", None, 0), (3, long_text, "fr", "a", 1), (4, "\n\n \t", "fr", "a", 4), (5, "#", "", None, 1)]
    clash = ("lo", "hi", "tree", "digest", "item", "path", "n", "fp", "shard", "label", "phrase", "k", "f", "part", "key", "hit")
    return spark.createDataFrame([(*r, *[k] * len(clash)) for k, r in enumerate(rows)], DOC + "".join(f", {c} int" for c in clash))


# --- phrases


def brute_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    cands = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = {}
    for (lang, p), a in cands.items():
        if any(la == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (la, q), b in cands.items()):
            continue
        score, cut = min((1000 * a * n[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]], n[lang]))
    return sorted((lang, r + 1, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, xs in out.items() for r, x in enumerate(sorted(xs)[:top]))


def texts(seed=1, n=120):
    rng = random.Random(seed)
    vocab = "of the and Of in la le état x1 new york city zed q bright idea . , ; : ! ? \n \r\n \t".split(" ")
    out = []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if k % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = "a rare fixed set phrase here".split()
        out.append((" ".join(words), rng.choice(["en", "fr", None, "und"])))
    return [*out, (None, "en"), ("", None), ("one", "de"), ("same same same same same same same same", "es"), ("Same, SAME same", "es")]


@pytest.mark.parametrize("least,top,slice_bytes", [(4, 2000, 1 << 20), (7, 5, 300), (2, 2000, 64)])
def test_collocations(spark, monkeypatch, least, top, slice_bytes):
    monkeypatch.setattr(phrases, "SLICE", slice_bytes)
    rows = texts()
    got = phrases.collocations(docs(spark, rows).repartition(3), least=least, top=top).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, least, top)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 50)
    for text in ("ab cd, " * 40, "word " * 60 + "." + "x y z. " * 30, "é" * 200, "." * 120, "no end " * 30):
        parts = list(phrases._cut(text))
        assert "".join(parts) == text and all(p[-1] in ".,;:!?\n\r" for p in parts[:-1])
        assert all(len(p.encode()) <= 50 or not re.search(r"[.,;:!?\n]", p[:-1]) or len(p.encode()) > 50 for p in parts)
    batch = pa.record_batch([pa.array(["a b. " * 30, "x", None, "", "c d " * 5, "y " * 80, "z"]), pa.array(["en", None, "en", "fr", "en", "en", "de"])], ["text", "lang"])
    words = Counter(w.decode() for s in phrases._slices([batch]) for w in s.words.take(pa.array(s.id)).to_pylist())
    assert words == Counter("a b ".split() * 30 + ["x"] + "c d".split() * 5 + ["y"] * 80 + ["z"])


def test_misra_gries_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(3)
    for threshold in (5, 20):
        stream = np.concatenate([rng.integers(0, 4000, 9000), np.repeat(rng.integers(5000, 5040, 40), threshold), rng.zipf(1.3, 3000) % 5000])
        rng.shuffle(stream)
        true = Counter(stream.tolist())
        s = phrases.MisraGries(len(stream) // threshold + 1)
        for part in np.array_split(stream, 17):
            k, c = np.unique(part, return_counts=True)
            s.merge(k.astype(np.uint32), c)
        assert s.error < threshold and len(s.keys) <= s.capacity
        kept = set(s.reaching(threshold).tolist())
        assert {k for k, n in true.items() if n >= threshold} <= kept
        assert all(true[k] - s.error <= n <= true[k] for k, n in zip(s.keys.tolist(), s.counts.tolist(), strict=True))


def test_summaries_by_partition(spark, monkeypatch):
    """Whatever the buffers, no frequent n-gram is lost and few others are kept."""
    rows = [(t, lang) for t, lang in texts(4, 300)]
    d = docs(spark, rows).select("text", "lang").repartition(5)
    monkeypatch.setattr(phrases, "BUFFER", 40)
    keys = {r.key for r in phrases.frequent(d, 8, phrases._short_phrases, 6).collect()}
    s = phrases.Slice([pa.array([t for t, _ in rows], pa.large_string())], [pa.array([x for _, x in rows], pa.large_string())])
    every = Counter(np.concatenate([phrases.short(h, 8) for h in phrases._short_phrases(s)]).astype(np.int64).tolist())
    assert {k for k, n in every.items() if n >= 6} <= keys and keys <= set(every)


def test_exact_arithmetic(spark):
    """Products past 64 bits."""
    one = spark.range(1).selectExpr("(cast(1000 as decimal(4,0)) * cast(9876543210987654 as decimal(16,0)) * cast(98765432109876543 as decimal(18,0))) div (cast(987654321098765 as decimal(18,0)) * cast(123456789012345678 as decimal(18,0))) as x").first().x
    assert one == 1000 * 9876543210987654 * 98765432109876543 // (987654321098765 * 123456789012345678)


# --- SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    sh = [" ".join(w)] if 0 < len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    up = list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    arr = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1 :]) <= 4) + i + 1:
            up[top(int(j))] = top(i)
    least = {}
    for k, i in enumerate(ids):
        least[top(k)] = min(least.get(top(k), i), i)
    return [least[top(k)] for k in range(len(ids))]


def test_simhash_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = table.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table.repartition(7)).collect()}
    assert got == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, want, strict=True)}
    assert len(set(want)) < len(rows)


def near_prints(seed, groups=60, alone=1500):
    """Fingerprints apart, chains of close ones, and one thick cluster."""
    rng = np.random.default_rng(seed)
    out = [*rng.integers(0, 2**63, alone).tolist(), 0, 1, 2**64 - 1]
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    for _ in range(groups):
        x = int(rng.integers(0, 2**63))
        for _ in range(int(rng.integers(1, 6))):
            out.append(x)
            x = flip(x, int(rng.integers(3, 7)))
    centre = int(rng.integers(0, 2**63))
    out += [flip(centre, int(rng.integers(0, 5))) for _ in range(700)]
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("shard,sample,few,piece", [(2048, 8192, 32, 4096), (40, 400, 8, 60), (16, 30, 8, 4096), (8, 8192, 4, 10)])
def test_trees_lose_no_link(spark, monkeypatch, shard, sample, few, piece):
    """Deep and shallow trees, with and without a sample for the nodes, shards in pieces: each link once."""
    for name, value in (("SHARD", shard), ("SAMPLE", sample), ("FEW", few), ("PIECE", piece)):
        monkeypatch.setattr(simhash, name, value)
    fp = near_prints(shard)
    table = stash(spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(4))
    got = sorted(tuple(sorted((r.a, r.b))) for r in simhash.linked(table, all_links=True).collect())
    i, j = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, 1))
    signed = fp.view(np.int64).tolist()
    assert got == sorted(tuple(sorted((signed[a], signed[b]))) for a, b in zip(i.tolist(), j.tolist(), strict=True))
    few = [(r.a, r.b) for r in simhash.linked(table).collect()]
    at = {x: k for k, x in enumerate(signed)}
    parts = [np.stack(simhash.forest(len(fp), [(np.array([at[a] for a, _ in es]), np.array([at[b] for _, b in es]))])).tolist() for es in (got, few)]
    assert parts[0] == parts[1] and len(few) < len(got)


def test_trees_prune():
    """A shard's residents and guests are few beside all fingerprints."""
    fp = np.random.default_rng(1).integers(0, 2**63, 60_000).astype(np.uint64)
    tree = simhash.Tree(1, fp[:8192], len(fp))
    row, shard, home = tree.route(fp)
    assert np.bincount(row[home], minlength=len(fp)).min() == 1 == np.bincount(row[home]).max()
    assert max(Counter(shard.tolist()).values()) < 3 * simhash.SHARD and len(row) < 5 * len(fp)


# --- manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)))


def brute_tree(leaves):
    """The root, and each leaf's siblings by level as (left, right)."""
    level, members, proof = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        nxt, groups = [], []
        for a in range(0, len(level), 8):
            for k in range(a, min(a + 8, len(level))):
                for i in members[k]:
                    proof[i].append(("".join(level[a:k]), "".join(level[k + 1 : a + 8])))
            nxt.append(sha("".join(level[a : a + 8])))
            groups.append([i for k in range(a, min(a + 8, len(level))) for i in members[k]])
        level, members = nxt, groups
    return level[0], proof


def brute_manifest(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r.lang, []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        rs = sorted(langs[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[lang] = (rs, *brute_tree([leaf(r) for r in rs]))
    root, above = brute_tree([trees[x][1] for x in order])
    out = []
    for lang, up in zip(order, above, strict=True):
        rs, sub, proofs = trees[lang]
        for r, p in zip(rs, proofs, strict=True):
            found = r
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
                found = type(r)(**(r.asDict() | {"text": r.text.translate(LOWER)}))
            x = leaf(found)
            for left, right in p + up:
                x = sha(left + x + right)
            out.append((str(r.doc_id), leaf(r), sub, root, sha("".join(a + b for a, b in p + up)), x, x == root))
    return sorted(out)


def manifest_rows(df):
    out = merkle.manifest(df, check=merkle.tampered(F.col("doc_id"), F.col("text")))
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof, r.folded_root, r.verified) for r in out.withColumn("proof", merkle.proof_digest(F.col("path"))).collect())


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 65, "fr": 64, "": 7, "de": 1, None: 130, "é": 3, "z": 2, "zz": 1, "a": 1, "b": 1}])
def test_manifest_against_brute_force(spark, sizes):
    rng = random.Random(1)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((rng.randrange(-50, 10_000), rng.choice(["Some Text é", "plain", "", None, "ABC"]), lang, rng.choice(["s", None]), rng.choice([1, None])))
    d = spark.createDataFrame(rows, DOC)
    assert manifest_rows(d.repartition(5)) == brute_manifest(d.collect())


def test_manifest_of_the_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got, want = manifest_rows(d), brute_manifest(d.collect())
    assert got == want and 0 < sum(not r[-1] for r in got) < len(got)
    whole = merkle.manifest(d).where("not verified").count()
    assert whole == 0  # nothing was tampered with


@pytest.mark.parametrize("name", ["op11", "op12", "op13"])
def test_odd_and_empty_tables(spark, name):
    f = {"op11": lambda d: phrases.collocations(d, least=2), "op12": simhash.near_duplicates, "op13": lambda d: merkle.manifest(d, check=merkle.tampered(F.col("doc_id"), F.col("text")))}[name]
    assert f(spark.createDataFrame([], DOC)).collect() == []
    d = odd(spark)
    got = f(d).collect()
    if name == "op11":
        assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == brute_phrases([(r.text, r.lang) for r in d.collect()], 2, 2000)
    if name == "op12":
        assert len(got) == 8 and {r.component_id for r in got if r.fingerprint == "0" * 16} == {2}
    if name == "op13":
        assert manifest_rows(d) == brute_manifest(d.select("doc_id", "text", "lang", "source", "n_chars").collect())
