"""The operators against brute force, SQL on odd rows, round trips and held-out labels."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import common, lines, minhash, mixing, packing, quality, queries, rules, urls, vectors

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, target string, taken int, words string, kept string, doc string"


def documents(spark, texts, sources=None):
    """Documents with columns whose names clash with those of results; ids are 0, 1, ... (texts may be (id, text))."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc_id, text, "en", (sources or ["a"])[i % len(sources or ["a"])], None if text is None else len(text), 7, "t", 3, "w", "no", "d"))
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(30)
    return [None, "", "  \n\t ", "one", "One two", "a b c", "a b c d", shared, shared, (7, shared), (None, shared), f"{shared} x", text(60) + "\n" + shared, "é ñ\n\n\né ñ", "x\n" * 40, "a b c " * 30, text(3000), "# $ % " * 40, "w x w x", "tail\n\n"]


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    r = con.sql(sql)
    return sorted(repr(dict(sorted(zip(r.columns, row, strict=True)))) for row in r.fetchall())


def spark_rows(df):
    return sorted(repr(dict(sorted(r.asDict().items()))) for r in df.collect())


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {row["id"]: row["component"] for row in common.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_apportionment_is_highest_quotients(spark):
    votes = {"a": 100.0, "b": 33.0, "c": 33.0, "d": 1.0, None: 7.0, "z": 0.0}
    for seats in (0, 1, 3, 10, 57, 1000):
        df = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "g int, p string, v double, k int")
        got = {r["p"]: r["quota"] for r in mixing.sainte_lague(df, ["g"], ["p"], "v", "k").collect()}
        order = sorted(((-v / (2 * s - 1), k is None, k or "", s, k) for k, v in votes.items() for s in range(1, seats + 2) if v), key=lambda x: x[:4])
        want = collections.Counter(x[4] for x in order[:seats])
        assert got == {k: want[k] for k in votes}


def test_mix_matches_sql_on_odd_rows(spark):
    tied = [(900, "same id w"), (900, "another text"), (900, "another text"), (None, "no id " * 90), (None, "nor here " * 70), (None, "no id " * 90)]
    docs = documents(spark, [*odd_texts(), *tied], ["b", None, "a", "\U0001f600", "c"])
    got = mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")
    assert spark_rows(got) == sql_rows(mixing.OP2_SQL, documents=docs.select("doc_id", "text", "source"))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got.collect())
    again = mixing.mix_documents(docs.orderBy(F.rand(1)).repartition(5), block=4)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, mixing.mix_documents(docs, block=4).collect()))
    assert mixing.mix_sources(docs.where("false")).count() == 0


def test_mixed_texts_have_the_words_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs, block=16).collect()}
    words = collections.Counter()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in mixing.mix_documents(docs, block=16).collect():
        words[r["doc_id"]] += len(r["text"].split())
        it = iter(texts[r["doc_id"]].split())
        assert all(w in it for w in r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(words)


def pages(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">x</a><a href="/own">y</a>' for h in hosts)
    rows = [
        (1, "http://good.com/a", link("mid.org", "Mid.org", "good.com")), (2, "https://mid.org/b?x#y", link("far.org")), (3, "http://far.org/", "<a HREF='//good.com'>"),
        (4, "http://bad.net/es/1", link("good.com")), (5, "http://shady.org/1", link("bad.net")), (6, "http://shadier.org/1", link("shady.org")), (7, "http://www.Example.com/en/1", None),
        (8, "http://example.com/en/1", ""), (9, "http://example.com", "x"), (10, None, link("good.com")), (11, "no scheme", None), (12, "http://a.net/fr/x", None), (13, "http://notexample.com/en/", None), (13, "http://notexample.com/en/", None),
    ]
    return spark.createDataFrame([(*r, "v", "h") for r in rows], "page_id bigint, url string, html string, verdict string, host string")


def test_urls(spark):
    df = pages(spark)
    got = urls.filter_pages(df)
    assert spark_rows(got) == sql_rows(urls.OP3_SQL, pages=df.select("page_id", "url", "html"))
    rows = {r["page_id"]: r for r in got.collect()}
    assert rows[7]["rule"] == "www.example.com/en/" and rows[8]["verdict"] == "block" and rows[9]["rule"] is None and rows[13]["rule"] == "com/"
    assert rows[5]["verdict"] == rows[6]["verdict"] == "block" and rows[2]["verdict"] == rows[3]["verdict"] == "allow" and rows[10]["verdict"] == "allow"
    assert rows[2]["trust"] > rows[3]["trust"] > 0 and rows[5]["distrust"] > rows[6]["distrust"] > 0
    assert urls.filter_pages(df.where("false")).count() == 0


def test_trust_reaches_far_hosts_and_cycles_end(spark):
    """A chain of 16 hosts from a trusted one, and a blocked host in a ring of three."""
    chain = ["seed.com", *[f"h{k}.org" for k in range(16)]]
    link = lambda host: f'<a href="https://{host}/x">'
    rows = [(k, f"https://{a}/p", link(b)) for k, (a, b) in enumerate(itertools.pairwise(chain))]
    ring = ["bad.net", "r1.org", "r2.org"]
    rows += [(100 + k, f"https://{h}/es/p", link(ring[(k + 1) % 3])) for k, h in enumerate(ring)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    judged = urls.filter_pages(df)
    got = {r["host"]: r for r in judged.collect()}
    mass = int(urls.UNIT * (1 - urls.DAMPING))
    for host in chain[:-1]:
        assert got[host]["trust"] == mass and got[host]["verdict"] == "allow"
        mass = int(float(mass) * urls.DAMPING)
    assert got[chain[-2]]["trust"] > 0
    exact = {h: (1 - urls.DAMPING) * urls.DAMPING**k / (1 - urls.DAMPING**3) for h, k in (("bad.net", 0), ("r2.org", 1), ("r1.org", 2))}
    assert all(abs(got[h]["distrust"] / urls.UNIT - x) < 1e-4 for h, x in exact.items())
    assert [got[h]["verdict"] for h in ring] == ["block"] * 3
    assert spark_rows(judged) == sql_rows(urls.OP3_SQL, pages=df)


@pytest.mark.parametrize("block", [1024, 3])
def test_vectors(spark, block):
    r = np.random.default_rng(3)
    rows, i = [], 0
    for label in (1, 2, None):
        for _ in range(12):
            base = r.standard_normal(8)
            for k in range(r.integers(1, 7)):
                rows.append((i, [float(x) for x in base + 0.12 * k * r.standard_normal(8)], label))
                i += 1
    rows += [(i + k, v, 1) for k, v in enumerate([None, [], [0.0] * 8, [1.0] * 7 + [None], [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], [1.0, 2.0], rows[0][1]])]
    rows += [rows[0], (None, rows[0][1], 1)]
    df = spark.createDataFrame([(*x, "n") for x in rows], "vec_id bigint, embedding array<double>, label int, n_links string")
    got = {row["vec_id"]: row for row in vectors.near_duplicate_vectors(df, block=block, tables=24).collect()}
    usable = {v[0]: (np.array(v[1]), v[2]) for v in rows if v[0] is not None and v[2] is not None and v[1] and None not in v[1] and np.isfinite(v[1]).all() and any(v[1])}
    links = {a: {b for b in usable if b != a and usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0]) and usable[a][0] @ usable[b][0] / np.linalg.norm(usable[a][0]) / np.linalg.norm(usable[b][0]) >= 0.98} for a in usable}
    for a in {x[0] for x in rows} - {None}:
        seen, todo = {a}, [a]
        while todo:
            new = links.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert got[a]["n_links"] == len(links.get(a, ())) and got[a]["component_id"] == min(seen) and got[a]["kept"] == (min(seen) == a), a
    assert got[None]["component_id"] == 0 and sum(len(x) for x in links.values()) > 40
    assert vectors.near_duplicate_vectors(df.where("false")).count() == 0


def test_vectors_of_any_size(spark):
    """Tiny and huge vectors link by direction; a shared vec_id mixes no vectors; bits grow with the largest label."""
    rows = [(1, [1e-200, 2e-200], 1), (2, [1e-200, 2.0000001e-200], 1), (3, [1.0, 2.0], 1), (4, [1e200, 2e200], 1), (5, [1e-200, 1e-200], 1), (6, [5e-324, 0.0], 1), (7, [1.0, 1e-300], 1), (1, [-1.0, 0.0], 1), (8, [-1.0, 0.001], 1)]
    got = {(r["vec_id"], r["n_links"]): r["component_id"] for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), tables=40).collect()}
    assert got == {(1, 3): 1, (2, 3): 1, (3, 3): 1, (4, 3): 1, (5, 0): 5, (6, 1): 6, (7, 1): 6, (1, 1): 1, (8, 1): 1}
    assert [vectors.tables_for(0.98, b) for b in (12, 20)] == [12, 23] and 1 - (1 - 0.268) ** 23 > 0.999


def test_vector_recall(spark):
    got = vectors.op4_embedding_near_dedup(spark, "/root/testdata/sf0.01")
    want = sql_rows(queries.ORACLE_SQL["op4_embedding_near_dedup"], embeddings=spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    same = len(set(spark_rows(got)) & set(want))
    assert same >= 0.99 * len(want)


def test_accuracies_by_plain_em():
    counts = {0: 3, 1093: 400, 1094: 9, 1100: 12, 2186: 5, 364: 30}
    prior, chance, posterior = quality.fit_accuracies(counts, rounds=7)
    docs = [quality.votes_of(c) for c, n in sorted(counts.items()) for _ in range(n)]
    good = [0.05 if 2 in v else 0.95 for v in docs]
    for _ in range(7):
        p = [(sum(1 - g for g in good) + 1) / (len(docs) + 2), (sum(good) + 1) / (len(docs) + 2)]
        table = [[[0.1] * 3 for _ in quality.LABELLERS] for _ in range(2)]
        for v, g in zip(docs, good, strict=True):
            for k, x in enumerate(v):
                table[0][k][x] += 1 - g
                table[1][k][x] += g
        table = [[[x / sum(row) for x in row] for row in c] for c in table]
        like = [[p[c] * float(np.prod([table[c][k][x] for k, x in enumerate(v)])) for c in range(2)] for v in docs]
        good = [b / (a + b) for a, b in like]
    assert np.allclose(prior, p) and np.allclose(chance, table)
    assert np.allclose([posterior[c] for c, n in sorted(counts.items()) for _ in range(n)], good)


def test_quality_on_labels_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    model = quality.fit(docs)
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs, model).collect()}
    right = [got[i] == bool(q) for i, q in labels.items()]
    assert sum(right) >= 0.95 * len(right)
    assert all(got[i] for i, q in labels.items() if q) or sum(not got[i] for i, q in labels.items() if q) <= 0.01 * len(right)
    odd = documents(spark, odd_texts())
    rows = quality.classify(odd, quality.fit(odd)).collect()
    assert len(rows) == len(odd_texts()) and all(0 <= r["score"] <= 1 and r["words"] == "w" for r in rows)
    assert quality.classify(odd.where("false"), quality.fit(odd.where("false"))).count() == 0


def line_texts():
    para = "\n".join(f"short {c} line" for c in "abcdefg")
    long = "this line has more than eight words in it for sure"
    return [f"start\n{para}\nend", f"other\n\n{para}\nrest", long, f"{long}\nnew", f"x\n{long}\n\n{long}", "The.\nAs.", "The.\nAs.", "one two three four\nfive six seven eight", "zero\none two three four\nfive six seven eight\n\n", None, "", "\n\n", para.replace("\n", "\n\n")]


def test_lines_match_sql(spark):
    docs = documents(spark, line_texts())
    got = lines.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")
    assert spark_rows(got) == sql_rows(lines.OP7_SQL, documents=docs.select("doc_id", "text"))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["text"] == "other\n\nrest" and rows[4]["text"] == "x" and rows[6]["text"] == "The.\nAs." and rows[8]["text"] == "zero" and rows[9]["text"] is None


def test_lines_repeated_rows_and_columns(spark):
    docs = documents(spark, [(1, "a b c d e f g h i"), (1, "a b c d e f g h i"), (None, "a b c d e f g h i"), (2, None)])
    out = lines.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert sorted(r["text"] for r in out.where("doc_id = 1").collect()) == ["", "a b c d e f g h i"]
    assert out.where("doc_id is null").first()["text"] == ""
    many = documents(spark, [(1, "a b c d e f g h i")] * 50 + [(2, "short")] * 3).withColumn("n_chars", (F.monotonically_increasing_id() % 2).cast("int"))
    left = lines.line_dedup(many).collect()
    assert len(left) == 53 and [r["text"] for r in left if r["doc_id"] == 1].count("a b c d e f g h i") == 1 and all(r["text"] == "short" for r in left if r["doc_id"] == 2)
    assert [r["n_removed"] for r in left if r["doc_id"] == 1].count(1) == 49
    assert lines.line_dedup(docs.where("false")).count() == 0


def test_rules_on_odd_rows(spark, tmp_path):
    more = ["- one\n* two\n\u2022 three", "and so on ...\nmore\u2026  \nend.", "the end of it is in that place. " * 12 + "\nq\nr", '"Said." ' * 3, "12 34 56\n78\n90", "x\ny\nz"]
    docs = documents(spark, [*odd_texts(), *more])
    ledger = rules.stored_ledger(docs, str(tmp_path / "ledger"))
    base = (ledger["fail_bits"].bitwiseAND(3) != 0).alias("base_failed")
    passes = [(ledger["fail_bits"].bitwiseAND(rules.mask_of(v)) == 0).alias(f"passes_{v}") for v in ("v1", "v3")]
    got = rules.apply_policy(ledger, "v2").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, "kept", "n_lines", "fail_bits", "rule_set", *passes)
    assert spark_rows(got) == sql_rows(rules.OP8_SQL, documents=docs.select("doc_id", "text"))
    assert spark_rows(rules.ablations(ledger)) == sql_rows(rules.ABLATIONS_SQL, documents=docs.select("doc_id", "text"))
    table = {(r["policy"], r["rule"]): r for r in rules.ablations(ledger).collect()}
    bits = [r["fail_bits"] for r in ledger.collect()]
    assert all(any(b >> i & 1 for b in bits) for i in range(len(rules.RULES)))
    for (policy, rule), r in table.items():
        mask, bit = rules.mask_of(policy), 1 << list(rules.RULES).index(rule)
        assert r["n_failed"] == sum(bool(b & bit) for b in bits) and r["n_failed_alone"] == sum(b & mask == bit for b in bits)
        assert r["n_kept"] == sum(not b & mask for b in bits) and r["n_kept_without"] == sum(not b & mask & ~bit for b in bits)
    ledger.withColumn("rule_set", F.lit(1)).write.parquet(str(tmp_path / "older"))
    with pytest.raises(ValueError):
        rules.read_ledger(spark, str(tmp_path / "older"))
    assert rules.stored_ledger(docs.where("false")).count() == 0


@pytest.mark.parametrize("rows_per_salt", [2, packing.ROWS_PER_SALT])
def test_packing(spark, rows_per_salt):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    texts = [*odd_texts(), "Don't, l'été ÀÉ's 12 <|endoftext|> a<|b İ ΣΑΣ _x_ 日本語"]
    docs = documents(spark, texts)
    got = packing.pack_sequences(docs, capacity=64, with_ids=True, rows_per_salt=rows_per_salt).collect()
    want = collections.Counter()
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 64)):
            piece = ids[at : at + 64]
            want[doc_id, n, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), tuple(piece)] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == list(itertools.accumulate([n for _, n in p[:-1]], initial=0)) and sum(n for _, n in p) <= 64
    assert packing.pack_sequences(docs.where("false")).count() == 0


def test_packing_plan():
    r = random.Random(2)
    for n in (3, 500, 20_000):
        counts = collections.Counter(r.choice([r.randint(1, 2048), 2048, r.randint(1, 200)]) for _ in range(n))
        plan = packing.packing_plan(counts)
        used = collections.Counter()
        for items, times in plan:
            assert sum(items) <= 2048
            for i in items:
                used[i] += times
        least = -(-sum(k * v for k, v in counts.items()) // 2048)
        assert used == counts and sum(t for _, t in plan) <= least * 1.02 + 1


def brute_components(docs, k):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(zip(*[w[j:] for j in range(k)], strict=False))
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((group[a], group[b]))
            group = {i: x if g == y else g for i, g in group.items()}
    return sets, group


def test_near_duplicates(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    texts = [t for t in odd_texts() if not isinstance(t, tuple)]
    for n in range(40):  # a chain of copies that drift apart, and copies of one text changed to different degrees
        base[r.randrange(120)] = f"n{n}"
        texts.append(" ".join(base))
        changed = list(base)
        for _ in range(r.randrange(9)):
            changed[r.randrange(120)] = f"c{r.randrange(9)}"
        texts.append(" ".join(changed).title())
    for k in (4, 5):
        sets, group = brute_components(list(enumerate(texts)), k)
        got = {row["doc_id"]: row for row in minhash.near_duplicates(documents(spark, texts), k=k).collect()}
        assert {i: (row["n_shingles"], row["component_id"], row["kept"]) for i, row in got.items()} == {i: (len(sets[i]), g, g == i) for i, g in group.items()}
    odd = minhash.near_duplicates(documents(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "q")])).collect()
    assert [r["component_id"] for r in odd].count(1) == 3 and len(odd) == 4
    assert minhash.near_duplicates(documents(spark, ["a"]).where("false")).count() == 0


def test_near_duplicates_match_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = minhash.op10_minhash_near_dedup(spark, "/root/testdata/sf0.01")
    assert spark_rows(got) == sql_rows(minhash.OP10_SQL, documents=docs)


def test_small_sets_of_a_large_bucket(spark, monkeypatch):
    """Short texts that all share a bucket: every pair at 0.8 links, whatever an estimate says."""
    r, texts = random.Random(4), []
    for g in range(150):
        base = [f"g{g}x{i}" for i in range(r.choice([8, 9, 12]))]
        texts += [" ".join(base), " ".join(base[:-1])]
    r.shuffle(texts)
    sketches = minhash.sketches

    def in_one_bucket(docs, k):
        made = sketches(docs, k)
        key = F.when(F.size("bands") > 0, F.array_repeat(F.lit(7).cast("long"), minhash.BANDS)).otherwise(F.col("bands"))
        return made.withColumn("bands", key)

    monkeypatch.setattr(minhash, "sketches", in_one_bucket)
    sets, group = brute_components(list(enumerate(texts)), 4)
    got = {row["doc_id"]: row["component_id"] for row in minhash.near_duplicates(documents(spark, texts), k=4).collect()}
    assert got == group and len(set(group.values())) == 150


def test_group_that_stays_open(spark, monkeypatch):
    """Copies of one text that differ from each other by just too much: what is compared does not become all their pairs, and links among them are found."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for g in range(240):
        words = list(base)
        for i in r.sample(range(300), 6):
            words[i] = f"g{g}x{i}"
        texts.append(" ".join(words))
    texts += [f"{t} more" for t in texts[:20]]
    r.shuffle(texts)
    asked, confirmed = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: asked.append(pairs.count()) or confirmed(pairs, *rest))
    monkeypatch.setattr(minhash, "BLOCK", 50)
    sets, group = brute_components(list(enumerate(texts)), 4)
    got = {row["doc_id"]: row["component_id"] for row in minhash.near_duplicates(documents(spark, texts), k=4).collect()}
    assert got == group and 100 < len(set(group.values())) < 241
    assert asked[-1] < 10 * len(texts)


def test_shared_shingles_of_blocks():
    """Counts by matrix and by pairs are those of the sets, within a block and between two."""
    r = np.random.default_rng(3)
    for left, right, pool in ((70, 0, 40), (1, 0, 5), (3, 90, 60), (80, 30, 2000)):
        drawn = r.integers(0, 2**64, pool, dtype=np.uint64)
        sets = [np.unique(r.choice(drawn, r.integers(1, pool // 2))) for _ in range(left + right)]
        got = minhash._in_common(np.concatenate(sets), np.array([len(x) for x in sets]), left)
        for i in range(left):
            for j in range(left if right else i + 1, left + right):
                assert got[i, j - left if right else j] == len(np.intersect1d(sets[i], sets[j]))


def test_sizes_of_estimates():
    r = np.random.default_rng(4)
    x = r.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.concatenate([x[:889], r.integers(0, 2**63, 111).astype(np.uint64)])
    share = (minhash._minima(np.unique(x)) == minhash._minima(np.unique(y))).mean()
    assert abs(share - 0.8) < 0.15


def test_estimates_from_bits(spark):
    """Estimates from two bits a slot, corrected for chance, are near the similarity, and near that of the whole minima."""
    r = np.random.default_rng(6)
    rows, want = [], []
    for common_part in (0, 100, 300, 600, 889, 1000):
        x = r.integers(0, 2**63, 1000).astype(np.uint64)
        y = np.concatenate([x[:common_part], r.integers(0, 2**63, 1000 - common_part).astype(np.uint64)])
        want.append(common_part / (2000 - common_part))
        for slots in (minhash.SLOTS, minhash.FINE_SLOTS):
            rows.append((len(want) - 1, slots, *(minhash._packed(minhash._minima(np.unique(z), slots)).view(np.int64).tolist() for z in (x, y))))
    df = spark.createDataFrame(rows, "i int, n int, x array<bigint>, y array<bigint>")
    for slots, margin in ((minhash.SLOTS, minhash.MARGIN), (minhash.FINE_SLOTS, minhash.FINE_MARGIN)):
        for row in df.where(f"n = {slots}").withColumn("e", minhash.estimate("x", "y", slots)).collect():
            assert abs(row["e"] - want[row["i"]]) < margin
            agree = sum((a >> 2 * k & 3) == (b >> 2 * k & 3) for a, b in zip(row["x"], row["y"], strict=True) for k in range(32)) / slots
            assert row["e"] == pytest.approx((agree - 0.25) / 0.75)


def shared_ids():
    """Rows that share an id though their texts differ, ids that are null, and copies of both."""
    a, b = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = lambda words, *more: " ".join([*words, *more])
    return [(1, near(a)), (1, near(b)), (2, near(a, "x")), (3, near(b, "x")), (None, near(a, "y")), (None, "only here without an id"), (None, "only here without an id"), (9, "alone in the world of texts"), (9, "alone in the world of texts"), (8, None), (8, None), (7, " ")]


def test_documents_of_several_texts(spark):
    got = minhash.near_duplicates(documents(spark, shared_ids())).collect()
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str)
    assert found == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (None, None, True), (9, 9, True), (9, 9, True), (8, 8, True), (8, 8, True), (7, 7, True)], key=str)
    apart = [(5, t) if i == 1 else (i, t) for i, t in shared_ids()[:4]]  # two groups that meet in document 5 only
    assert {r["component_id"] for r in minhash.near_duplicates(documents(spark, apart)).collect()} == {2}


def test_one_row_of_each_group(spark):
    docs = documents(spark, shared_ids())
    left = minhash.one_per_group(docs)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    rows = shared_ids()
    assert got == sorted([rows[0], rows[1], rows[5], rows[7], rows[9], rows[10], rows[11]], key=str)  # texts that share an id stay, repeated rows do not
    assert minhash.one_per_group(docs.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "mix_sources", "best_fit_packing"]
    made = []
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SF), name)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        made.append((docs, out))
        docs = out
    check_stages(spark, made)
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows(spark, empty):
    """Nulls in every column, blank and long texts, repeated rows, shared ids, clashing columns: each stage against brute force."""
    import corpus_pipeline

    prose = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()
    texts = [*odd_texts(), *shared_ids(), *((100 + i, r["text"]) for i, r in enumerate(prose)), (100, prose[0]["text"]), ("null", None)]
    texts = [(None, None) if t == ("null", None) else t for t in texts]
    docs = documents(spark, texts, ["a", None, "b", "c"])
    docs = (docs.where("false") if empty else docs).withColumn("component", F.lit(1)).withColumn("row", F.lit("r")).withColumn("score", F.lit("s")).withColumn("n_lines", F.lit(-1)).withColumn("block", F.lit(None).cast("int"))
    made = []
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SF), name)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        made.append((docs, out))
        docs = out
    if not empty:
        check_stages(spark, made)
    else:
        assert docs.count() == 0


def check_stages(spark, made):
    """What each stage gave against a plain computation on its input."""
    (docs, good), (_, fewer), (_, single), (_, mix), (_, packed) = made
    model = quality.fit(docs)
    judged = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect() if plain_score(r["text"], model) >= quality.THRESHOLD)
    assert judged == collections.Counter((r["doc_id"], r["text"]) for r in good.collect())

    kept_lines = collections.Counter(line for r in fewer.collect() for line in (r["text"] or "").split("\n") if len(line.split()) >= lines.MIN_WORDS)
    assert set(kept_lines.values()) <= {1} and set(kept_lines) == {line for r in good.collect() for line in (r["text"] or "").split("\n") if len(line.split()) >= lines.MIN_WORDS}

    texts = [(i, r["text"]) for i, r in enumerate(fewer.collect())]
    sets, group = brute_components(texts, 5)
    assert single.count() == len({group[i] for i, _ in texts if sets[i]}) + sum(not sets[i] for i, _ in texts)

    words = collections.Counter(w for r in single.collect() for w in (r["text"] or "").split())
    assert all(n <= 2 * words[w] for w, n in collections.Counter(w for r in mix.collect() for w in (r["text"] or "").split()).items())
    mixed = mixing.mix_sources(single).agg({"taken": "sum"}).first()[0] or 0
    assert sum(len((r["text"] or "").split()) for r in mix.collect()) == mixed

    rows = packed.collect()
    tokenizer = packing.word_ids(packing.default_tokenizer()).tokenizer
    want = sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mix.collect())
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in places.values():
        placed.sort()
        assert placed[0][0] == 0 and sum(n for _, n in placed) <= 2048 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(placed))
    assert sum(r["length"] for r in rows) == want


def plain_score(text, model):
    """The scorer's verdict by loops over trigrams and measures."""
    raw = (text or "").encode()
    m, d = quality.measure(raw), model["dimensions"]
    x = collections.Counter()
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        x[(((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & 0xFFFFFFFF) >> 16) % d] += 1 / (len(raw) - 2)
    z = float(model["weights"][-1]) + sum(v**0.5 * float(model["weights"][k]) for k, v in x.items())
    for k, v in enumerate(m):
        z += float(model["weights"][(k * 7919 + sum(e < v for e in quality.BINS) * 104729) % d])
    return 1 / (1 + np.exp(-z))


def test_scores_by_loops(spark):
    docs = documents(spark, [*odd_texts(), "Some words, more words; and 12 | 13 !!"])
    model = quality.fit(docs)
    for r in quality.classify(docs, model).collect():
        assert r["score"] == pytest.approx(plain_score(r["text"], model), abs=1e-4)


def test_features_of_long_texts(monkeypatch):
    text = bytes(np.random.default_rng(5).integers(0, 256, 5000, dtype=np.uint8))
    whole = quality.features(text, quality.measure(text))
    for chunk in (1, 2, 7, 4998, 4999, 5000):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        assert np.array_equal(quality.features(text, quality.measure(text)), whole)


def test_scorer_by_plain_descent():
    """Gradient descent with momentum on soft labels, by loops over rows."""
    r = np.random.default_rng(3)
    x, y = r.normal(0, 1, (12, 3)).astype(np.float32), r.random(12).astype(np.float32)
    w, v = [0.0] * 4, [0.0] * 4
    for _ in range(30):
        g = [0.0] * 4
        for row, label in zip(x.tolist(), y.tolist(), strict=True):
            off = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(row, w[:3], strict=True)) + w[3]))) - label
            g = [a + off * b / 12 for a, b in zip(g, [*row, 1.0], strict=True)]
        v = [0.9 * a - 0.1 * (b + 1e-4 * c) for a, b, c in zip(v, g, w, strict=True)]
        w = [a + b for a, b in zip(w, v, strict=True)]
    assert np.allclose(quality.fit_scorer(x, y, rounds=30), w, atol=1e-4)


def test_sample_is_bounded_and_of_different_texts(spark):
    docs = documents(spark, ["the same text again"] * 300 + [f"text {i} with other words" for i in range(300)])
    asked = []
    real = quality.fit_scorer
    quality.fit_scorer = lambda x, y: asked.append(len(x)) or real(x, y)
    try:
        quality.fit(docs, sample=50)
        quality.fit(docs, sample=5000)
    finally:
        quality.fit_scorer = real
    assert 10 <= asked[0] <= 50 and asked[1] == 301


def test_agreement_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs.select("doc_id", "text"), quality.fit(docs)).select("doc_id", "kept").collect()}
    assert sum(got[i] == bool(q) for i, q in labels.items()) >= 0.98 * len(labels)
