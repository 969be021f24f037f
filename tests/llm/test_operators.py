"""The text operators against brute force, on the smallest tables and on rows made to be awkward."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rallyline.llm import langid, licences, lines, mixing, packing, perplexity, recipes, simhash, sketches, urls
from rallyline.llm import queries as registered

DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 97} and{i % 13}\n" for i in range(20_000))
ODD = [
    (1, "The same text here.\nAll rights reserved, line one", "en", "b"),
    (2, "The  same text\there.\nAll rights reserved, line one", "en", "b"),
    (3, None, None, None),
    (4, "", "de", "a"),
    (5, "  \n\t ", "fr", "a"),
    (6, LONG, "en", "hot"),
    (7, LONG, "en", "hot"),
    (7, LONG, "en", "hot"),
    (8, "two words", "en", "hot"),
    (9, "ÉCOLE Straße ÀÉ cc by CC-BY general public license\n\nall rights reserved", "fr", "hot"),
    (None, "no id at all, and a shared long line", "es", "hot"),
    (10, "no id at all, and a shared long line\nno id at all, and a shared long line", "es", "hot"),
    (11, "日本語 テキスト <|endoftext|> we'll x\x0by\x0cz", "ja", "hot"),
    (12, "12345 !!!", "en", "hot"),
]
NAMES = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, row int, fp int, line string, words string, part int, keys int, kept int, nth int, shard int, template string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, None if r[1] is None else len(r[1]), 7, "k", 7, 7, "l", "w", 7, 7, 7, 7, 7, "t") for r in ODD]
    return spark.createDataFrame(rows, NAMES).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def words(text):
    return (text or "").encode().lower().split()


def classes_of(prints, radius):
    """Smallest reachable id by id, trying all pairs."""
    ids = sorted(prints, key=lambda i: (i is None, i))
    least = {i: i for i in ids}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)), key=ids.index)
                least[b] = a
    return {i: root(i) for i in ids}


def brute_print(text, width=3):
    import xxhash

    w = words(text)
    grams = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_components(docs, texts):
    prints = {i: brute_print(t) for i, t in texts.items()}
    expected = classes_of(prints, 2)
    rows = simhash.near_components(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", expected[i]) for i in texts}


def test_simhash_odd_rows(odd, none):
    rows = simhash.near_components(odd).collect()
    assert len(rows) == len(ODD)
    of = {r["doc_id"]: r for r in rows}
    assert of[3]["fingerprint"] == "0" * 16 == of[4]["fingerprint"]
    assert of[3]["component_id"] == of[4]["component_id"] == of[5]["component_id"] == 3
    assert of[7]["component_id"] == 6 and of[2]["component_id"] == 1
    assert simhash.near_components(none).count() == 0 and simhash.near_dedup(none).count() == 0
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and None in {r["doc_id"] for r in kept.collect()}


def test_bk_tree_links_are_exact():
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 2**63, 20)]
    values = sorted({b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for b in base for _ in range(20)})
    expected = classes_of(dict(enumerate(values)), 2)
    least = {v: v for v in values}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for u, v in simhash.link_runs(values, 2, 1 << 20):
        a, b = sorted((root(u), root(v)))
        least[b] = a
    assert {i: values.index(root(v)) for i, v in enumerate(values)} == expected


def test_near_dedup_finds_similar_texts(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, groups = [], {}
    for g in range(40):
        base = [vocabulary[i] for i in rng.integers(0, 3000, 300)]
        for c in range(1 + 2 * (g % 2)):
            copy = list(base)
            for at in rng.integers(0, 300, 3 * c):
                copy[at] = "changed"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {groups[k] for k in kept} == set(range(40))
    assert len(kept) <= 42


def jaccard(a, b, width=5):
    a, b = ({tuple(x[i : i + width]) for i in range(max(1, len(x) - width + 1))} for x in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_dedup_is_by_exact_similarity(spark):
    """Pairs at 0.8 or a little more end as one document, pairs at 0.7 or a little more stay two, in a chain as well."""
    rng = np.random.default_rng(2)
    rows, alike = [], {}
    for g in range(200):
        base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
        copy, low = list(base), 0.7 if g % 2 else 0.8
        for at in rng.permutation(400):
            at_once = [*copy[:at], f"new{g}", *copy[at + 1 :]]
            if jaccard(" ".join(base), " ".join(at_once)) >= low:
                copy = at_once
        alike[2 * g] = jaccard(" ".join(base), " ".join(copy))
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(i in kept for i in alike)
    assert all(i + 1 in kept for i, a in alike.items() if a < 0.8)
    found = [i + 1 not in kept for i, a in alike.items() if a >= 0.8]
    assert len(found) == 100 and sum(found) >= 95


def test_part_counts_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(8)
    for size in (1, 5, 60, 400, 3000):
        for _ in range(60):
            x = rng.integers(0, 2**64, 2 * size, dtype=np.uint64)
            a, b = np.unique(x[:size]), np.unique(x[(at := int(rng.integers(size // 4 + 1))) : at + size])
            alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            counts = simhash.part_counts(a)[None]
            assert alike < 0.8 or simhash.may_be_similar(counts, simhash.part_counts(b), 0.8)[0]
    assert not simhash.may_be_similar(simhash.part_counts(x[:300])[None], simhash.part_counts(x[60:360]), 0.8)[0]


def test_near_dedup_joins_what_only_some_member_matches(spark):
    """A member that the first tried partner fails is still linked by another: classes are those of all true pairs."""
    rng = np.random.default_rng(4)
    line = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    rows = [(0, " ".join(line))]
    for i in range(1, 12):
        line = list(line)
        for at in range(4):
            line[33 * i + 7 * at] = f"step{i}"
        rows.append((i, " ".join(line)))
    assert all(jaccard(rows[i][1], rows[i + 1][1]) >= 0.85 for i in range(11)) and jaccard(rows[0][1], rows[11][1]) < 0.5
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [0]


def test_crowded_keys_give_the_same_classes(spark, monkeypatch):
    """A key that is parted into blocks finds what it finds as one shard: tight groups, variants of one base, chains."""
    rng = np.random.default_rng(14)
    rows = []
    for g in range(4):
        base = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        for c in range(30):
            copy = list(base)
            for at in rng.integers(0, 300, (0, 3, 6, 9)[g]):
                copy[at] = f"new{c}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = simhash.settled(docs)
    roots_at = {}
    for crowd in (1 << 16, 5):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        named, links = simhash.similar_links(docs)
        doc_of = {r["id"]: r["doc_id"] for r in named.collect()}
        assert all(jaccard(rows[doc_of[r["u"]]][1], rows[doc_of[r["v"]]][1]) >= 0.8 for r in links.collect())
        roots_at[crowd] = {doc_of[r["node"]]: doc_of[r["root"]] for r in simhash.components(links).collect()}
    assert roots_at[5] == roots_at[1 << 16] and len(roots_at[5]) > 50


def test_near_dedup_is_by_row(spark):
    """Rows that repeat an id, or have none, are compared and kept by their texts."""
    rng = np.random.default_rng(3)
    base, other = (" ".join(f"w{i}" for i in rng.integers(0, 5000, 300)) for _ in range(2))
    rows = [(1, base), (5, base + " more"), (5, other), (7, other + " more"), (None, base + " and more"), (None, "quite another text"), (None, "quite another text"), (9, None), (9, "")]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in got) == Counter([(1, base), (5, other), (None, "quite another text"), (9, "")])


def test_large_near_group_ends_in_few(spark):
    """Runs of one shard hand their classes on: a group far longer than a run becomes one."""
    values = [1 << (i % 200) for i in range(200)]
    links = simhash.link_runs(values, 2, 16)
    assert len(links) == 199


def test_variants_that_only_match_their_base_stay_linked():
    """A shard longer than a run: each variant is near the base alone, wherever the base stands in the order."""
    rng = np.random.default_rng(5)
    base = int.from_bytes(rng.bytes(32), "little")
    flips = [rng.choice(256, 44, replace=False).tolist() for _ in range(4000)]
    values = sorted({base, *(base ^ sum(1 << b for b in f) for f in flips)})
    links = simhash.link_runs(values, 44, simhash.RUN)
    seen, ends = {base}, defaultdict(set)
    for u, v in links:
        assert (u ^ v).bit_count() <= 44
        ends[u].add(v)
        ends[v].add(u)
    stack = [base]
    while stack:
        new = ends[stack.pop()] - seen
        seen |= new
        stack.extend(new)
    assert len(links) == len(values) - 1 and seen == set(values)


def test_wide_links_make_the_classes_of_all_pairs():
    rng = np.random.default_rng(9)
    base = [int.from_bytes(rng.bytes(32), "little") for _ in range(15)]
    values = sorted({b ^ sum(1 << int(i) for i in rng.choice(256, int(rng.integers(30)), replace=False)) for b in base for _ in range(20)})
    at = {v: i for i, v in enumerate(values)}
    least = dict(enumerate(range(len(values))))

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for u, v in simhash.link_runs(values, 20, 1):
        a, b = sorted((root(at[u]), root(at[v])))
        least[b] = a
    assert {i: root(i) for i in least} == classes_of(dict(enumerate(values)), 20)


def test_exact_groups(odd, none, docs, texts):
    for df, rows in ((odd, [r[:2] for r in ODD]), (docs, list(texts.items()))):
        same = defaultdict(list)
        for i, t in rows:
            same[re.sub(r"[ \t-\r]+", " ", t or "")].append(i)
        got = recipes.exact_groups(df).collect()
        assert len(got) == len(rows)
        expected = Counter()
        for text, ids in same.items():
            keep = min((i for i in ids if i is not None), default=None)
            sha = hashlib.sha256(text.encode()).hexdigest()
            expected.update((i, keep, len(ids), sha) for i in ids)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
        assert sum(r["kept"] for r in got) == len(same)
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = recipes.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len({re.sub(r"[ \t-\r]+", " ", t or "") for _, t, *_ in ODD})
    assert recipes.exact_groups(none).count() == 0 == recipes.exact_dedup(none).count()


def test_exact_dedup_is_by_row(spark):
    """One row of each text stays, whatever other rows share its id or have none."""
    rows = [(1, "B"), (5, "A"), (5, "B"), (None, "B"), (None, "C"), (None, "C"), (6, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    kept = Counter((r["doc_id"], r["text"]) for r in recipes.exact_dedup(docs).collect())
    assert kept == Counter([(1, "B"), (5, "A"), (None, "C"), (6, None)])


def test_colliding_chunk_hashes_are_told_apart(spark):
    chunk = lambda sha: {"short": 5, "sha": sha, "size": 9}
    made = spark.createDataFrame([(1, [chunk(b"a")]), (2, [chunk(b"b")]), (3, [chunk(b"a")])], "row long, chunks array<struct<short: long, sha: binary, size: int>>")
    got = {r["row"]: r["recipe"] for r in recipes.verified_recipes(made).collect()}
    assert got[1] == got[3] != got[2]


def test_chunks_follow_content():
    data = np.random.default_rng(2).integers(97, 123, 60_000, dtype=np.uint8).tobytes()

    def parts(d):
        ends = recipes.cuts(d)
        return [d[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    a, b = set(parts(data)), set(parts(b"inserted in front" + data))
    assert len(a & b) > 0.8 * len(a)
    assert b"".join(parts(data)) == data


def brute_lines(rows, least=10):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    last = math.inf
    first = {}
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(last if i is None else i)
    first = {k: min(v) for k, v in holders.items() if len(v) > 1 and len(k) >= least}
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if key(x) not in first or first[key(x)] == (last if i is None else i)]
        yield i, len(own), len(own) - len(kept), "\n".join(kept)


def test_line_dedup(odd, none, docs, texts):
    for df, rows in ((odd, [r[:2] for r in ODD]), (docs, list(texts.items()))):
        got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.line_dedup(df).collect())
        assert got == Counter(brute_lines(rows))
    assert lines.line_dedup(none).count() == 0


@pytest.mark.parametrize("kind", ["odd", "docs"])
def test_packing(kind, odd, docs, texts):
    from tokenizers import Tokenizer

    df, rows = (odd, [r[:2] for r in ODD]) if kind == "odd" else (docs, list(texts.items()))
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    got = packing.packed(df, with_ids=True).toPandas()
    assert got["length"].sum() == sum(len(ids[i]) for i, _ in rows)
    for r in got.itertuples():
        own = ids[None if r.doc_id != r.doc_id else r.doc_id]
        piece = own[r.start : r.start + r.length]
        assert (np.array(r.ids) == piece).all() and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(own)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 4096


def test_packing_is_tight_and_empty_input_works(none):
    rng = np.random.default_rng(4)
    sizes = sorted((int(x) for x in rng.integers(1, 4000, 600)), reverse=True)
    made = packing.windows(sizes, 4096)
    assert sorted(i for w in made for i in w) == list(range(600))
    assert len(made) <= 1.06 * sum(sizes) / 4096
    assert packing.windows([], 4096) == [] and packing.packed(none).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_gives_its_own_ids(name):
    """The short way is taken for the known front end alone; every other tokenizer sees whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    whole, encode = Tokenizer.from_file(path), packing.Encoder(path, 2)
    for text in (*(t or "" for _, t, *_ in ODD), " lead", "a  b\n\n c\u00a0d", "don't WE'LL x<|endoftext|>y", "½²①e\u0301"):
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]


def test_windows_are_as_few_as_can_be():
    """Against the least possible number: the sum over the capacity, or the items too large to share a window."""
    rng = np.random.default_rng(12)
    for low, high, over in ((1, 400, 1.02), (1, 4096, 1.08), (2049, 4096, 1.0), (1000, 1400, 1.55)):
        sizes = sorted((int(x) for x in rng.integers(low, high, 300)), reverse=True)
        least = max(-(-sum(sizes) // 4096), sum(2 * s > 4096 for s in sizes))
        made = packing.windows(sizes, 4096)
        assert all(sum(sizes[i] for i in w) <= 4096 for w in made) and least <= len(made) <= over * least + 1


def brute_places(text, phrase):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if x]
    n = len(phrase.split())
    return len(w), [i for i in range(len(w) - n + 1) if w[i : i + n] == phrase.split()]


def test_licences(odd, none):
    got = {r["doc_id"]: r for r in licences.labelled(odd).collect()}
    for i, text, *_ in ODD:
        places = {t.label: brute_places(text, t.text) for t in licences.BASE}
        starts = [s for _, found in places.values() for s in found]
        r = got[i]
        assert r["n_words"] == places["gpl"][0] and r["n_base"] == len(starts)
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted(k for k, (_, found) in places.items() if found))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert licences.labelled(none).count() == 0


def test_licence_templates(spark):
    rows = [(1, "x. Released under the MIT License."), (2, "MIT License"), (3, "Licensed under the Apache License, Version 2.0!"), (4, "MIT and license")]
    got = {r["doc_id"]: r for r in licences.labelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["mit", "", "apache-2.0", ""]
    assert got[1]["score"] == 1 == got[3]["score"]


def brute_perplexity(trusted, order=4):
    """Interpolated modified Kneser-Ney by the book, with dictionaries."""
    fold = lambda t: "".join("0" if c in "0123456789" else " " if c in " \t\n\x0b\x0c\r\0" else c for c in t)
    grams = lambda t: [("\0" * (order - 1) + fold(t))[i : i + order] for i in range(len(t))]
    counts = {order: Counter(g for t in trusted for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: perplexity.discounts([sum(n == i for n in c.values()) for i in (1, 2, 3, 4)]) for k, c in counts.items()}
    totals = {k: Counter() for k in counts}
    cuts = {k: Counter() for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            totals[k][g[:-1]] += n
            cuts[k][g[:-1]] += d[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        context, n = g[:-1], counts[k][g]
        if not totals[k][context]:
            return p(g[1:])
        own = (n - d[k][min(n, 3) - 1]) / totals[k][context] if n else 0
        return own + cuts[k][context] / totals[k][context] * p(g[1:])

    def of(text):
        logs = [math.log(p(g)) for g in grams(text)]
        return math.exp(-sum(logs) / len(logs)) if logs else None

    return of


def test_perplexity_is_by_the_book(spark, docs, monkeypatch):
    """Every document's perplexity, the threshold of each language, and the verdicts; also with tiny blocks and pieces."""
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    extra = [(900001, "Привет, мир! 日本語テキスト", "ru"), (900002, "😀 ½ ² ①\n42", "ru"), (900003, "", "de"), (None, "no id", "en")]
    rows = docs.select("doc_id", "text", "lang").orderBy(F.char_length("text")).limit(60)
    rows = rows.unionByName(spark.createDataFrame(extra, rows.schema)).coalesce(2)
    rows = spark.createDataFrame(rows.collect(), rows.schema).repartition(2)
    labels = labels.unionByName(spark.createDataFrame([(900001, 1, 0)], "doc_id long, quality long, toxic long").select(*[F.col(c).cast(t) for c, t in labels.dtypes]))
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    every = rows.collect()
    trusted = [r["text"] for r in every if r["doc_id"] in good]
    assert len(trusted) > 10
    brute = brute_perplexity(trusted)
    expected = {r["doc_id"]: brute(r["text"]) for r in every}
    for chunk, block in ((perplexity.CHUNK, perplexity.BLOCK), (7, 900)):
        monkeypatch.setattr(perplexity, "CHUNK", chunk)
        monkeypatch.setattr(perplexity, "BLOCK", block)
        monkeypatch.setattr(perplexity.chunks, "__defaults__", (chunk,))
        got = {r["doc_id"]: r for r in perplexity.judged(rows, labels, 0.5).collect()}
        assert len(got) == len(every)
        for i, r in got.items():
            assert r["perplexity"] is None if expected[i] is None else math.isclose(r["perplexity"], expected[i], rel_tol=1e-9), i
    for lang in {r["lang"] for r in every}:
        own = sorted(expected[r["doc_id"]] for r in every if r["doc_id"] in good and r["lang"] == lang)
        for r in every:
            if r["lang"] == lang and own:
                assert math.isclose(got[r["doc_id"]]["threshold"], own[math.ceil(0.5 * len(own)) - 1], rel_tol=1e-9)
                limit = got[r["doc_id"]]["threshold"] * math.exp(perplexity.CHANCE / math.sqrt(max(1, len(r["text"]))))
                assert got[r["doc_id"]]["kept"] == (r["text"] != "" and expected[r["doc_id"]] <= limit)


def test_good_rows_stay_beside_rejected_ones_with_their_id(spark):
    """Rows are judged by themselves: a rejected row takes no other row without an id, or with its id, along."""
    clean = "the cat sat on the mat and the dog sat on the rug " * 4
    rows = [(i, clean) for i in range(30)] + [(None, clean), (None, "#%&$ " * 40), (7, "@@!!~~ " * 40), (None, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(20) if i != 7], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = Counter((r["doc_id"], r["text"]) for r in perplexity.keep_good(docs, labels).collect())
    assert kept == Counter((i, t) for i, t in rows if t == clean)


def test_perplexity_verdicts(spark, docs, odd, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = perplexity.judged(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert rows[rows.quality == 1].kept.mean() > 0.98
    assert rows[rows.quality == 0].kept.mean() < 0.5
    got = perplexity.judged(odd, labels.unionByName(labels)).collect()
    assert len(got) == len(ODD) and not any(r["kept"] for r in got if r["doc_id"] in (3, 4))
    kept = perplexity.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert perplexity.judged(none, labels).count() == 0
    # without trusted rows only empty text is rejected
    got = perplexity.judged(odd, labels.where("false")).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == {3, 4}


def test_language_accuracy(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predicted(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(rows.doc_id, rows.held_out, strict=True))
    out = rows[rows.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.98 and rows.score.between(0, 1).all()
    got = {r["doc_id"]: r for r in langid.predicted(odd).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 12))
    assert langid.predicted(none).count() == 0
    signs = spark.createDataFrame([(1, "½ ² ① _ 7", "en"), (2, "½ é", "en"), (3, "ª", "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predicted(signs).collect()} == {1: "und", 2: "en", 3: "en"}
    assert {r["lang_pred"] for r in langid.predicted(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_sample_is_bounded_without_ids(spark, monkeypatch):
    """Rows that share an id, or have none, or are equal, are drawn one by one."""
    seen = []
    real = langid.durable
    monkeypatch.setattr(langid, "durable", lambda df: seen.append(df := real(df)) or df)
    rows = [(None, f"der und die {i} Wort", "de") for i in range(600)] + [(1, "the and of word", "en")] * 600
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2), per_language=60)
    counts = {r["lang"]: r["count"] for r in seen[0].groupBy("lang").count().collect()}
    assert all(25 <= counts[lang] <= 110 for lang in ("de", "en"))


URLS = ["https://A.Example.COM/en/7?x", "http://example.com/en/8#y", "x", None, "", "ftp://a.net", "http://b.net/de/1", "https://example.net/de/81/z",
        "http://example.net?de/8", "http://org/es/", "http://xorg/es/1", "a://b://c/en/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id long, url string, host string, path string")
    got = {r["page_id"]: r for r in urls.judged(pages).collect()}
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host.lower() == h or host.lower().endswith(f".{h}")) and path.startswith(p)]
        _, verdict, rule = max(fits, default=(0, None, None))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host.lower(), path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert urls.judged(pages.where("false")).count() == 0


def test_url_templates_learn_from_rules(spark):
    rows = [f"http://s.com/en/{i}" for i in range(40)] + [f"http://s.com/shop/en/{i}" for i in range(5)] + [f"http://t.com/fr/{i}" for i in range(9)]
    rows += [f"http://u.com/x-{i}/en/9" for i in range(9)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judged(pages).collect()}
    assert all(got[i]["verdict"] == "block" for i in range(40))
    assert all(got[i]["verdict"] == "allow" for i in range(40, len(rows)))


def test_learnt_templates_block_what_no_rule_names(spark):
    """Unruled URLs built like mostly blocked ones are blocked; those built otherwise, or far more than the blocked, aren't."""
    rows = [f"http://s.com/en/{i}" for i in range(40)] + [f"http://s.com/fr/{i}.html" for i in range(9)] + ["http://s.com/about"]
    rows += [f"http://s.com/img/{i}/logo.png" for i in range(30)]
    few = [f"http://h.org/es/{i}" for i in range(50)]
    for n in (18, 20, 40):  # more branches of the same kind, and of others, change nothing
        urls_of = rows + few + [f"http://h.org/x{chr(97 + i // 26)}{chr(97 + i % 26)}/{i}" for i in range(n)]
        urls_of += [f"http://h.org/y{i}/z/{i}" for i in range(10 * n)]
        pages = spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string")
        got = [r["verdict"] for r in sorted(urls.judged(pages).collect(), key=lambda r: r["page_id"])]
        assert set(got[:49]) == {"block"} and set(got[49:80]) == {"allow"}, n
        assert set(got[80 : 130 + n]) == {"block"} and set(got[130 + n :]) == {"allow"}, n
    many = [f"http://s.com/en/{i}" for i in range(40)] + [f"http://s.com/fr/{i}" for i in range(300)]
    pages = spark.createDataFrame(list(enumerate(many)), "page_id long, url string")
    assert {r["verdict"] for r in urls.judged(pages).where("page_id >= 40").collect()} == {"allow"}
    rules = (("block", "t.org", "/bad"), ("allow", "t.org", "/good"))
    mixed = [f"http://t.org/{a}/{i}" for a in ("bad", "good", "plain") for i in range(30)]
    pages = spark.createDataFrame(list(enumerate(mixed)), "page_id long, url string")
    got = urls.judged(pages, rules).collect()
    assert {r["verdict"] for r in got if r["page_id"] >= 60} == {"allow"}
    assert {r["template"] for r in got} == {None, "/bad/#"}


def brute_templates(rows):
    """Template by (host, shape) from (host, shape, said), a node at a time."""
    plain = lambda rest: re.sub(r"[0-9#]+", "#", re.sub(r"[^\W\d_]+", "w", re.sub(r"(\.[A-Za-z0-9]{1,5})?/*$", "", rest)))
    found = {}

    def node(host, template, under):  # under: (shape, rest, urls, labels, blocked)
        if len({u[1] for u in under}) == 1:
            found.update({(host, u[0]): f"{template}/{u[1]}" for u in under})
            return
        branches, kinds, sums = defaultdict(list), {}, defaultdict(lambda: [0, 0, 0])
        for u in under:
            branches[u[1].partition("/")[0]].append(u)
        for segment, us in branches.items():
            of = Counter()
            for u in us:
                of[plain(u[1])] += u[2]
            kinds[segment] = max(of, key=lambda k: (of[k], k))
            for j, n in enumerate((1, sum(u[3] for u in us), sum(u[4] for u in us))):
                sums[kinds[segment]][j] += n
        deeper = defaultdict(list)
        for segment, us in branches.items():
            n, labels, blocked = sums[kinds[segment]]
            own, bad = sum(u[3] for u in us), sum(u[4] for u in us)
            differs = own and abs(bad / own - blocked / labels) > 1.96 * math.sqrt(blocked / labels * (1 - blocked / labels) / own)
            name = f"{template}/{segment}" if n == 1 or segment == "" or differs else f"{template}/*<{kinds[segment]}>"
            for u in us:
                if "/" in u[1]:
                    deeper[name].append((u[0], u[1].partition("/")[2], *u[2:]))
                else:
                    found[host, u[0]] = name
        for name, us in deeper.items():
            node(host, name, us)

    counts = defaultdict(lambda: [0, 0, 0])
    for host, shape, said in rows:
        for j, n in enumerate((1, said is not None, said == "block")):
            counts[host, shape][j] += n
    hosts = defaultdict(list)
    for (host, shape), n in counts.items():
        if shape:
            hosts[host].append((shape, shape.removeprefix("/"), *n))
        else:
            found[host, shape] = ""
    for host, under in hosts.items():
        node(host, "", under)
    return found, counts


def test_url_tree_against_a_plain_one(spark):
    rng = np.random.default_rng(3)
    parts = ["en", "fr", "de", "shop", "item-1", "7", "a.html", "page2", ""]
    made = [f"http://h{rng.integers(3)}.com/" + "/".join(parts[k] for k in rng.integers(0, 9, rng.integers(1, 5))) for _ in range(500)]
    real = [r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").select("url").collect()]
    for every in (made, real):
        pages = spark.createDataFrame(list(enumerate(every)), "page_id long, url string")
        got = urls.judged(pages).collect()
        rows = [(r["host"], re.sub("[0-9]+", "#", r["path"]), r["verdict"] if r["rule"] else None) for r in got]
        found, counts = brute_templates(rows)
        mine = urls.templates(spark.createDataFrame(rows, "host string, shape string, said string")).collect()
        assert {(r["host"], r["shape"]): r["template"] for r in mine} == found
        totals = defaultdict(lambda: np.zeros(3))
        for key, n in counts.items():
            totals[key[0], found[key]] += n
        bad = {k for k, (n, labels, blocked) in totals.items() if (blocked + 1) / (labels + 3 + 0.5 * (n - labels)) > 0.5}
        for r, (host, shape, said) in zip(got, rows, strict=True):
            assert r["verdict"] == (said or ("block" if (host, found[host, shape]) in bad else "allow"))
            assert r["template"] == (found[host, shape] if (host, found[host, shape]) in bad else None)
    assert any(r["verdict"] == "block" and not r["rule"] for r in got)


def brute_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, made, free = 1.5 * sum(size.values()), {}, dict(weight)
    while free:
        total = sum(free.values())
        over = [s for s in free if left * free[s] / total > 2 * size[s]]
        if not over:
            return made | {s: left * w / total for s, w in free.items()}
        for s in over:
            made[s] = 2.0 * size[s]
            del free[s]
        left = 1.5 * sum(size.values()) - sum(made.values())
    return made


def spark_copy(df):
    """The same rows in other partitions."""
    return df.sparkSession.createDataFrame(df.collect()[::-1], df.schema).repartition(5)


def test_mixing_selects_seeded_blocks(spark):
    """By hand for one shard: whole passes, then the blocks of documents in the seeded order; another seed takes others."""
    rows = [(i, " ".join(["w"] * (37 * i % 500)), "ab"[i % 5 == 0]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_seed = {}
    for seed in (42, 43):
        got = {r["doc_id"]: r for r in mixing.mixed(docs, seed).collect()}
        by_seed[seed] = [got[i]["taken"] for i in range(60)]
        mark = F.xxhash64(F.lit(seed), "doc_id", "text")
        order = docs.select("doc_id", F.xxhash64(F.lit(seed), mark).alias("at")).collect()
        for source in "ab":
            own = {i: got[i]["size"] for i in got if rows[i][2] == source}
            quota, size = sum(got[i]["taken"] for i in own), sum(own.values())
            assert abs(quota - got[min(own)]["target"]) <= 2 * mixing.BLOCK
            expected = {i: quota // size * n for i, n in own.items()}
            left = quota % size
            for r in sorted((r for r in order if r["doc_id"] in own), key=lambda r: r["at"]):
                words_in = min(own[r["doc_id"]], left)
                expected[r["doc_id"]] += words_in
                left -= words_in
            assert expected == {i: got[i]["taken"] for i in own}
    assert by_seed[42] != by_seed[43]


def words_by_source(df):
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return {r["source"]: (r["words"], r["n"]) for r in df.groupBy("source").agg(F.sum(size).alias("words"), F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("share", [0.3, 0.6, 1.0, 1.4, 2.0])
def test_mixture_meets_a_share(spark, share, monkeypatch):
    """Whole documents of all lengths, in shards of different sources: words within 2 %, and long ones as often as short ones."""
    rng = np.random.default_rng(int(10 * share))
    sizes = [int(x) for x in np.clip(rng.lognormal(5, 1.2, 4000), 1, 5000)]
    docs = spark.createDataFrame([(i, "w " * n, "ab"[i % 4 == 0]) for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    goals = {"a": share, "b": 2 * share % 1.7}

    def asked(sources):
        goal = F.when(F.col("source") == "a", goals["a"]).otherwise(goals["b"]) * F.col("source_size")
        return sources.withColumn("target", goal)

    monkeypatch.setattr(mixing, "targets", asked)
    out = mixing.mixture(docs, seed=1)
    before, after = words_by_source(docs), words_by_source(out)
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    for source, goal in goals.items():
        words, n = after[source]
        assert abs(words - goal * before[source][0]) <= 0.02 * goal * before[source][0]
        # a share of the words is that share of the documents, but for chance
        assert abs(n / before[source][1] - goal) <= 0.08


def test_mixture_of_documents_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    before, after = words_by_source(docs), words_by_source(mixing.mixture(docs))
    for source, goal in brute_targets({s: w for s, (w, _) in before.items()}).items():
        assert abs(after[source][0] - goal) <= 0.02 * goal, source


def test_mixture_copies_rows_by_their_own_plan(spark):
    """Rows with one id and size but other texts each come as often as their own plan says."""
    rows = [(7, f"{chr(97 + i)} " * 50, "s") for i in range(26)] + [(8, "x " * 3000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mixed(docs).collect()
    out = Counter(r["source"] for r in mixing.mixture(docs).collect())
    for source in "st":
        assert out[source] == sum(r["copies"] for r in plan if r["source"] == source)
    assert sum(r["taken"] for r in plan if r["source"] == "s") <= 2 * 26 * 50


def test_mixing(odd, none, docs, texts):
    for df, source in ((odd, None), (docs, None)):
        rows = mixing.mixed(df).toPandas().astype({"source": object})
        rows["source"] = rows["source"].where(rows["source"].notna(), None)
        size = defaultdict(int)
        for s, n in zip(rows["source"], rows["size"], strict=True):
            size[s] += n
        target = brute_targets(size)
        taken = defaultdict(int)
        for r in rows.itertuples():
            assert math.isclose(r.target, target[r.source], abs_tol=1e-6) and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in size)
        again = mixing.mixed(spark_copy(df)).select("doc_id", "size", "taken").collect()
        assert Counter(again) == Counter(mixing.mixed(df).select("doc_id", "size", "taken").collect())
    assert mixing.mixed(none).count() == 0 == mixing.mixture(none).count()
    assert mixing.mixture(odd).columns == odd.columns


def test_sainte_lague_is_the_highest_quotients(spark):
    rng = np.random.default_rng(6)
    votes = [int(x) for x in rng.integers(1, 10_000, 30)] + [3] * 200
    parties = spark.createDataFrame(list(enumerate(votes)), "p int, v long")
    for seats in (7, 100, 1234):
        got = {r["p"]: r["n"] for r in mixing.apportion(parties, "v", F.lit(seats), [], ["p"], "n").collect()}
        quotients = sorted(((-v / (2 * s + 1), p) for p, v in enumerate(votes) for s in range(seats)))[:seats]
        expected = Counter(p for _, p in quotients)
        assert sum(got.values()) == seats
        # ties at the last quotient may go either way, so the granted quotients are what is compared
        mine = sorted(-votes[p] / (2 * s + 1) for p, n in got.items() for s in range(n))
        assert np.allclose(mine, [q for q, _ in quotients]), (seats, expected)


def test_sketches(odd, none, docs, texts):
    rows = {r["doc_id"]: r for r in sketches.fingerprinted(docs).collect()}
    order = sorted(texts, reverse=True)
    for n, i in enumerate(order):
        text, other = texts[i], texts[order[(n + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, b, c = (set(t.split("\n")) for t in (text, edited, other))
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r["near_edited"], len(a & b) / len(a | b)) and math.isclose(r["near_next"], len(a & c) / len(a | c))
    got = sketches.fingerprinted(odd).collect()
    assert len(got) == len(ODD)
    of = defaultdict(set)
    for r in got:
        of[r["doc_id"]].add(r["fingerprint"])
    assert of[6] == of[7] and of[3] == of[4]
    assert sketches.fingerprinted(none).count() == 0
    one = sketches.fingerprinted(odd.where("doc_id = 9")).first()
    assert one["near_next"] == 1


def test_fingerprints_subtract_and_peel(spark):
    """Two written fingerprints give back the digests that differ, by side; the same as from the texts."""
    texts_of = [("a\nb\nc\nd", "a\nb\nx\nd\ny"), ("", "one"), ("same\nlines", "same\nlines"), ("\n".join(map(str, range(300))), "\n".join(map(str, range(7, 302))))]
    df = spark.createDataFrame(texts_of, "a string, b string")
    df = df.select(sketches.document(F.col("a")).alias("a"), sketches.document(F.col("b")).alias("b"))
    df = df.select("a", "b", sketches.parsed(sketches.fingerprint(F.col("a"))).alias("p"), sketches.parsed(sketches.fingerprint(F.col("b"))).alias("q"))
    width = F.least("p.width", "q.width")
    cells = [sketches.folded(F.col(f"{c}.cells"), width) for c in "pq"]
    df = df.select("a", "b", sketches.peel(sketches.subtract(*cells), width).alias("d"))
    rows = sketches.with_difference(df, "a", "b", "e").collect()
    for r in rows:
        a, b = set(r["a"]["digests"]), set(r["b"]["digests"])
        expected = {(1, x) for x in a - b} | {(-1, x) for x in b - a}
        assert {(k["s"], k["d"]) for k in r["e"]} == expected and len(r["e"]) == len(expected)
        assert {(k["s"], k["d"]) for k in r["d"]} == expected


def test_peeling_fails_softly_and_retries(spark, monkeypatch):
    """Sets far beyond a width don't peel at it, and do at a wider one; the difference is right either way."""
    rng = np.random.default_rng(8)
    sets = [[int(x) for x in rng.integers(-(2**62), 2**62, n)] for n in (5, 40, 300)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(sets)], "i int, a array<long>")
    tries = df.select(*[F.size(sketches.peel(sketches.sketch(F.col("a"), F.lit(w).cast("long")), F.lit(w).cast("long"))).alias(f"w{w}") for w in (16, 256)])
    tries = tries.collect()
    assert tries[0][0] == 5 and tries[2][0] in (None, -1) and tries[2][1] == 300
    lines_of = [("\n".join(str(x) for x in range(n)), "\n".join(str(x) for x in range(n // 2, m))) for n in (1, 9, 60) for m in (3, 200, 900)]
    df = spark.createDataFrame(lines_of, "a string, b string")
    for again in (sketches.AGAIN, ()):  # with no wider try, digests are told one by one
        monkeypatch.setattr(sketches, "AGAIN", again or (1,))
        made = df.select("a", "b", sketches.document(F.col("a")).alias("x"), sketches.document(F.col("b")).alias("y"))
        got = sketches.with_likeness(made, "x", "y", "l").collect()
        for r in got:
            a, b = set(r["a"].split("\n")), set(r["b"].split("\n"))
            assert math.isclose(r["l"], len(a & b) / len(a | b))


def test_peeling_grows_with_the_digests(spark):
    """Four times the paragraphs take about four times as long, not their square; all of them are found."""

    def seconds(n):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n) + F.col("id")), lambda i: F.xxhash64(i)).alias("a"))
        width = F.lit(2**15 * n // 24_000).cast("long")
        began = time.perf_counter()
        assert df.select(F.size(sketches.peel(sketches.sketch(F.col("a"), width), width))).first()[0] == n
        return time.perf_counter() - began

    few, many = (min(seconds(n) for _ in range(2)) for n in (6_000, 24_000))
    assert many < 8 * few, (few, many)


def test_next_documents_in_falling_order(spark):
    """The next document is found across gaps, ties, repeats and null ids, and the last is followed by the first."""
    rng = np.random.default_rng(4)
    ids = [*range(0, 40, 3), 1000, 4095, 4096, 2**25, 10**15, -5, -(10**12), None, None, None, 7, 7, *rng.integers(-(2**63), 2**63 - 1, 50).tolist()]
    rows = [(i, f"t{n}") for n, i in enumerate(ids)] + [(7, "twin"), (7, "twin")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    got = Counter((r["doc_id"], r["text"], r["next_text"]) for r in sketches.with_next(df).collect())
    order = sorted(set(rows), key=lambda r: (-(2**63) if r[0] is None else r[0], marks[r[1]]), reverse=True)
    after = {r: order[(n + 1) % len(order)][1] for n, r in enumerate(order)}
    assert got == Counter((*r, after[r]) for r in rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at = docs
    seen = {"docs": docs}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, DATA)
        if name != "packing":
            assert at.columns == docs.columns
        seen[name] = at = spark.createDataFrame(at.toPandas(), at.schema)
    ids = {k: {r["doc_id"] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    norm = lambda df: [re.sub(r"[ \t-\r]+", " ", r["text"]) for r in df.collect()]
    exact = norm(seen["exact dedup"])
    assert len(exact) == len(set(exact)) and set(exact) == set(norm(seen["quality classifier"]))
    grams = {}
    for r in seen["exact dedup"].collect():
        w = words(r["text"])
        grams[r["doc_id"]] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    kept = ids["simhash near-dedup"]
    assert all(any(alike(i, j) > 0.5 for j in kept) for i in ids["exact dedup"] - kept)
    pairs = [(i, j) for i in kept for j in kept if i < j and alike(i, j) >= 0.85]
    assert len(pairs) <= 0.01 * len(kept)
    assert ids["packing"] == ids["source mixing"] <= kept
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()} == ids["packing"]


def test_registered_queries(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, text in registered.oracle_sql().items():
        df = registered.queries()[name](spark, DATA)
        found = con.sql(text)
        order = sorted(df.columns)
        assert order == sorted(found.columns)
        theirs = sorted(tuple(str(r[found.columns.index(c)]) for c in order) for r in found.fetchall())
        assert sorted(tuple(str(r[c]) for c in order) for r in df.collect()) == theirs
    assert sum(name.startswith("op") for name in registered.queries()) == 13
