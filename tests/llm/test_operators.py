import collections
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, decontaminate, language, quality, sharding, toxicity, urls, warc
from gridloom.llm.common import Scratch, bitmap, marked
from gridloom.llm.registry import ORACLE_SQL, QUERIES

from . import brute


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_quality_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in quality.quality(odd_docs.withColumn("kept", F.lit("x"))).collect()}
    assert (got[1].n_words, got[1].word_chars, got[1].base_failed, got[1].kept) == (0, 0, True, False)
    assert got[3].n_words == 0 and got[9].n_words == 3 and got[9].word_chars == 11
    assert got[14].n_words == 400 and got[14].n_repeat_words == 400 and got[14].base_failed
    assert got[11].n_words == 30_000 and got[11].n_repeat_words == 0
    assert quality.quality(no_docs).collect() == []


def test_repeated_words_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("ab"), n)) for n in (7, 8, 9, 12, 30, 60, 61)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.quality(df).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = collections.Counter(wins)
        assert got[k] == len({i + j for i, x in enumerate(wins) if n[x] > 1 for j in range(8)})


def test_cleaned_text(spark):
    t = "This is a line that is fine and ends.\nhome | about | news | shop\nAccept cookies now, please do.\n\nAnother good line of the text."
    df = spark.createDataFrame([(t,)], "text string")
    assert df.select(quality.cleaned_text(F.col("text"))).first()[0] == "This is a line that is fine and ends.\n\nAnother good line of the text."


def test_cleaned_agrees_with_quality(docs, odd_docs):
    """One pass gives what the verdict and the removal give by themselves."""
    for df in (docs.select("doc_id", "text"), odd_docs.select("doc_id", "text")):
        both = quality.quality(df).select("doc_id", F.when(F.col("kept"), quality.cleaned_text(F.col("text"))).alias("a"), quality.cleaned(F.col("text")).alias("b")).collect()
        assert all(r.a == r.b for r in both) and len(both) == df.count()


@pytest.mark.parametrize("line", ["Bitte die Cookies akzeptieren, danke sehr.", "© 2020, Tous droits réservés par la société.", "Lea la POLÍTICA DE PRIVACIDAD de este sitio.", "Voici les Conditions d'utilisation du site."])
def test_boilerplate_of_all_languages(spark, line):
    df = spark.createDataFrame([(line, "A line of text that says what there is to say.")], "a string, b string")
    assert df.select(quality.line_fails(F.col("a")), quality.line_fails(F.col("b"))).first()[:] == (True, False)


def test_letters_that_grow_in_lower_case(spark):
    """What is lost is measured on the text itself: İ is one character, its lower case two."""
    text = " ".join(f"word{k}" for k in range(30)) + ".\n" + "\n".join(f"Click {x} " + "İ" * 40 for x in ("here", "HERE"))
    own = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    lost, whole = 2 * 49, len("".join(text.split()))
    for share in (lost / whole - 0.01, lost / whole + 0.01):
        assert quality.quality(own, max_lost=share).first().kept == (lost <= share * whole)


def test_shuffle_is_uniform():
    """Chi-square over all 24 x 24 ways that four rows, told apart, can go to four places, with two parts."""
    import random

    for parts in ((2, 2), (3, 1), (4,)):
        seen, draws = collections.Counter(), 24 * 400
        for seed in range(draws):
            rng, rows, at = random.Random(-seed - 1), list("abcd"), 0
            matrix, shards = sharding.communication_matrix(list(parts), [2, 2], seed), ([], [])
            for n, counts in zip(parts, matrix, strict=True):
                own, at = rows[at : at + n], at + n
                rng.shuffle(own)
                for shard, k in zip(shards, counts, strict=True):
                    shard += own[:k]
                    own = own[k:]
            for shard in shards:
                rng.shuffle(shard)
            seen["".join(shards[0] + shards[1])] += 1
        assert len(seen) == 24 and sum((n - 400) ** 2 / 400 for n in seen.values()) < 49.7  # 23 degrees, one in a thousand


def test_places_of_rows_are_uniform(spark):
    """Chi-square of the operator itself: each of 24 rows, over many seeds, in each of its places."""
    df, seen, seeds = spark.range(24).coalesce(1), np.zeros((24, 24)), 72
    outs = [sharding.shard(df, 4, seed=10 * s, parts=4, cells=2).withColumn("s", F.lit(s)) for s in range(seeds)]
    whole = outs[0]
    for o in outs[1:]:
        whole = whole.union(o)
    for r in whole.collect():
        seen[r.id, 6 * r.shard + r.slot] += 1
    chi = ((seen - seeds / 24) ** 2 / (seeds / 24)).sum()
    assert abs(chi - 23 * 23) < 3.3 * (2 * 23 * 23) ** 0.5


def check_shards(rows, shards):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding(spark, docs, odd_docs, no_docs):
    out = sharding.shard(docs.select("doc_id", F.lit(1).alias("slot"))).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.collect())
    check_shards(out, 16)
    check_shards(sharding.shard(odd_docs.select("doc_id"), 3, parts=4, cells=2).collect(), 3)
    assert sharding.shard(no_docs.select("doc_id")).collect() == []
    same = spark.createDataFrame([(1,)] * 500, "doc_id bigint")
    check_shards(sharding.shard(same, 7).collect(), 7)


def test_matrix_has_its_margins_and_law():
    counts, sizes = [5, 0, 7, 12, 1], sharding.shard_sizes(25, 4)
    for seed in range(50):
        m = sharding.communication_matrix(counts, sizes, seed)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m, strict=True)] == sizes
    import random

    rng = random.Random(0)
    draws = np.array([sharding.hypergeometric(rng, 30, 50, 20) for _ in range(4000)])
    assert abs(draws.mean() - 7.5) < 0.15 and abs(draws.var() - 20 * 0.375 * 0.625 * 60 / 79) < 0.3
    assert sharding.hypergeometric(rng, 10**9, 10**9, 10**6) == pytest.approx(5e5, rel=0.01)


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    word = lambda n: [f"t{k}" for k in rng.integers(0, 900, n)]
    items = [(k, word(n)) for k, n in enumerate((3, 6, 9, 15, 20, 25, 40, 60))]
    rows, k = [(None, None), (0, None), (1, "")], 2
    for _, t in items:
        for subs in (0, 1, 2):
            w = list(t)
            for at in rng.choice(len(w), min(subs, len(w) // 8), replace=False):
                w[at] = "other"
            rows.append((k, " ".join(word(30) + w + word(30))))
            k += 1
    rows += [(k + j, " ".join(word(100))) for j in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_ids", F.lit("clash"))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(50, None), (51, ""), (None, "only a null id here")], "item_id bigint, text string")
    want = {i: sorted(v) for i, v in brute.leaks(rows, [(i, " ".join(t)) for i, t in items]).items()}
    for sent in (1_000_000, 0):
        got = decontaminate.decontaminate(df, bench, sent=sent).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.item_ids for r in got if r.contaminated} == want
    clean = decontaminate.decontaminate(df, bench.where("item_id < 0")).collect()
    assert not any(r.contaminated for r in clean)


def matched(spark, items, docs):
    """(number of the document, item) -> matched tokens, for lists of words."""
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id bigint, text string")
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id bigint, text string")
    return {(r.doc_id, i): r.n_matched for r in decontaminate.decontaminate(df, bench).collect() for i in r.item_ids}


def test_substitutions_are_found(spark):
    """A passage of twenty tokens keeps a seed wherever one token is replaced."""
    item = [f"i{k}" for k in range(20)]
    docs = [[f"a{k}" for k in range(20)] + item[:at] + ["7"] + item[at + 1 :] + [f"b{k}" for k in range(20)] for at in range(20)]
    assert matched(spark, [(9, item)], docs) == {(at, 9): 19 for at in range(20)}


def test_matches_at_the_ends_of_texts(spark):
    """A long item that begins before the document or ends after it, and one of which only the middle is there."""
    item = [f"i{k}" for k in range(60)]
    docs = [item[:25], item[35:], item[10:40], item[:19], ["x"] * 5 + item[41:], item[:10] + ["x"] * 4 + item[14:30], [], ["x"], item * 3]
    assert matched(spark, [(4, item), (5, item[:7])], docs) == {(0, 4): 25, (0, 5): 25, (1, 4): 25, (2, 4): 30, (3, 5): 7, (4, 4): 19, (5, 4): 26, (5, 5): 26, (8, 4): 60, (8, 5): 60}


def test_clashing_names_and_repeated_texts(spark):
    names = ["k1", "k2", "n", "ids", "row", "again", "a.b", "contaminated"]
    item = " ".join(f"i{k}" for k in range(12))
    rows = [(k, t, *names) for k, t in enumerate([item, item, item.upper(), None, "", "other", None, item])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(1, item), (1, item), (2, item.upper()), (None, item)], "item_id bigint, text string")
    for sent in (0, 100):
        got = decontaminate.decontaminate(df, bench, sent=sent).collect()
        assert {r.doc_id: (r.contaminated, r.item_ids, r.n_matched) for r in got} == {k: (k in (0, 1, 2, 7), [1, 2] if k in (0, 1, 2, 7) else [], 12 if k in (0, 1, 2, 7) else 0) for k in range(8)}
        assert all(r[n] == n for r in got for n in names[:-1])


@pytest.mark.parametrize("n", range(8, 21))
def test_every_allowed_replacement_leaves_a_seed(n):
    subs, masks = n // 5, decontaminate.masks_for(n)
    places = [{k + j for j, bit in enumerate(m) if bit == "1"} for m in masks for k in range(n - len(m) + 1)]
    assert all(any(p.isdisjoint(gone) for p in places) for gone in itertools.combinations(range(n), subs))


def test_full_share_of_replacements_is_found(spark):
    """A fifth of the tokens of a short item, or of one window of a long one, replaced at random."""
    rng = np.random.default_rng(3)
    items, docs, want = [], [], {}
    word = lambda n: [f"t{k}" for k in rng.integers(0, 1 << 60, n)]
    for i, n in enumerate((8, 10, 12, 15, 16, 19, 20, 25, 40)):
        items.append((i, word(n)))
        for _ in range(60):
            w = min(n, 20)
            at, doc = int(rng.integers(n - w + 1)), word(60)
            doc[20 : 20 + w] = items[i][1][at : at + w]
            for k in 20 + rng.choice(w, w // 5, replace=False):
                doc[k] = "7"
            for d in (doc, doc[20 : 20 + w]):
                want[len(docs), i] = w - w // 5
                docs.append(d)
    assert matched(spark, items, [*docs, docs[0][:5], []]) == want


def test_other_windows_and_shares_keep_a_seed():
    for window in range(1, 31):
        for share in (0.3, 0.5, 0.75, 0.9, 1.0):
            first, *others = decontaminate.masks_for(40, window, share)
            subs = window - math.ceil(share * window) if window >= 8 else 0
            if others:  # those of the test above
                assert [first, *others] == decontaminate.masks_for(window) and subs <= window // 5
            else:
                assert set(first) == {"1"} and window - subs > (subs + 1) * (len(first) - 1)


def test_language(spark, docs, odd_docs, no_docs):
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)
    model = language.learn(docs)
    got = language.predict(odd_docs.select("doc_id", "text", F.lit(1).alias("score")), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert by[1].lang_pred == by[2].lang_pred == by[16].lang_pred == "und" and by[4].lang_pred in {"en", "de", "fr", "es"}
    assert language.predict(no_docs, model).collect() == []
    empty = language.learn(no_docs)
    assert {r.lang_pred for r in language.predict(odd_docs, empty).collect()} == {"und"}


def test_backoff_uses_shorter_grams():
    words = np.array([language._hash("known")], dtype=np.uint64)
    model = {"langs": ["a", "b"], "words": words, "rows": np.log(np.array([[0.9, 0.1]])), "grams": {"^xyz": 0, "q": 1}, "gram_rows": np.log(np.array([[0.2, 0.8], [0.7, 0.3]]))}
    s = language.Scorer(model)
    assert s.one("known")[0] == "a" and s.one("xyz")[0] == "b" and s.one("qqq")[0] == "a"
    assert s.one("!!! 12") == ("und", 0.0)


def test_language_equals_brute_force(spark):
    """Tables and scores from their definition, in plain Python; rows without lang or text teach nothing."""
    rng = np.random.default_rng(8)
    word = lambda letters: "".join(rng.choice(list(letters), rng.integers(1, 7)))
    rows = [(k, ("x", "y", "z")[k % 3], " ".join(word(("abcde", "cdefg", "efgéß")[k % 3]) for _ in range(12))) for k in range(60)]
    rows += [(100, None, "abc abc"), (101, "x", None), (102, "x", ""), (7, "y", "Cd. CD cd7cd")]
    model = language.learn(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"))
    counts = {"x": collections.Counter(), "y": collections.Counter(), "z": collections.Counter()}
    for _, lang, text in rows:
        if lang and text:
            counts[lang].update(w for w in language.WORD.findall(text.lower()))
    grams = {lang: collections.Counter() for lang in counts}
    for lang, c in counts.items():
        for w, n in c.items():
            m = f"^{w}$"
            for size in language.ORDERS:
                for i in range(len(m) - size + 1):
                    grams[lang][m[i : i + size]] += n
    known = {w for c in counts.values() for w in c}

    def logs(of, universe, key):
        total = {lang: sum(n for k, n in of[lang].items() if k in universe) for lang in of}
        return np.array([math.log((of[lang][key] + 0.1) / (total[lang] + 0.1 * len(universe))) for lang in sorted(of)])

    assert len(model["words"]) == len(known) and set(model["grams"]) == {g for c in grams.values() for g in c}
    texts = [" ".join(word("abcdefgéßq") for _ in range(n)) for n in (1, 2, 5, 30, 30, 30)] + ["abc Abc", "q", "é. ß!", "ccc 5 ddd_eee"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    for r in language.predict(df.withColumn("copy", F.col("text")), model).collect():
        words, sums = language.WORD.findall(r.copy.lower()), np.zeros(3)
        for w in words:
            if w in known:
                sums += logs(counts, known, w)
                continue
            m = f"^{w}$"
            for size in language.ORDERS:
                universe = {g for c in grams.values() for g in c if len(g) == size}
                own = [m[i : i + size] for i in range(len(m) - size + 1) if m[i : i + size] in universe]
                if own:
                    sums += sum(logs(grams, universe, g) for g in own) / len(own)
                    break
        mean = np.exp((sums - sums.max()) / max(1, len(words)))
        assert r.lang_pred == "xyz"[int(sums.argmax())] and r.score == pytest.approx(1 / mean.sum(), rel=1e-4)


def test_toxicity(spark, docs, data, odd_docs, no_docs):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    machine = toxicity.learn(docs, labels)
    odd = toxicity.score(odd_docs.withColumn("score", F.lit("x")), machine).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert toxicity.score(no_docs, machine).collect() == []
    blank = toxicity.learn(docs, labels.where("doc_id < 0"))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.5}


@pytest.fixture(scope="module")
def labelled(spark):
    root = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{root}/labels.parquet")


def test_held_out_toxicity(labelled):
    """Found on rows that were not learned from, and scores that add up to the toxic ones there are."""
    docs, labels = labelled
    machine = toxicity.learn(docs.where(~toxicity.held_out()), labels.where(~toxicity.held_out()))
    got = toxicity.score(docs.where(toxicity.held_out()), machine).join(labels, "doc_id").collect()
    bad, good = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad) and sum(r.predicted for r in good) <= 0.01 * len(good)
    assert abs(np.mean([r.score for r in got]) - len(bad) / len(got)) < 0.03


def test_held_out_labels_are_not_read(spark, data, docs):
    """Labels of held-out rows, and texts without a label, change no score."""
    labels = spark.read.parquet(f"{data}/labels.parquet")
    run = lambda own: {r.doc_id: r.score for r in toxicity.score(docs.select("doc_id", "text"), toxicity.learn(docs.where(~toxicity.held_out()), own.where(~toxicity.held_out()))).collect()}
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert run(labels) == run(turned)


def as_rows(docs):
    return toxicity.Rows(np.concatenate([np.array(sorted(d), dtype=np.int64) for d in docs]), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))


def test_scores_equal_the_formula(spark):
    """Every word and every beginning counts, each pair once: by a double loop over the terms."""
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "abc" for b in ("", "lmno", "lmnopq") for c in ("", "xy")]
    terms = sorted({h for w in words for h in toxicity._terms(w)})
    m = toxicity.Machine(np.array(terms), rng.normal(size=len(terms)), rng.normal(0, 0.3, (len(terms), 3)), 0.2)
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 5, 30)] + ["", "12 !", "Alm ALM alm"]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score(df, m).collect()}
    at = {t: k for k, t in enumerate(terms)}
    for k, t in [*enumerate(texts), (99, "")]:
        own = sorted({i for w in t.lower().split() if w.isalpha() for h in {*toxicity._terms(w)} if (i := at.get(h)) is not None})
        margin = m.b + sum(m.w[i] for i in own) + sum(float(m.v[i] @ m.v[j]) for i in own for j in own if i < j)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-margin)))


def test_machine_learns_a_pair():
    """Two terms, each neutral by itself: toxic with both or with neither, which no weights can tell."""
    rng = np.random.default_rng(0)
    docs = [{*(10 + rng.integers(0, 300, 20)).tolist(), *(k for k in (0, 1) if rng.random() < 0.5)} for _ in range(4000)]
    y = np.array([float((0 in d) == (1 in d)) for d in docs])
    w, v, b = toxicity.fit(as_rows(docs), y, 310)
    right = lambda *machine: np.mean((toxicity.Machine(np.arange(310), *machine).margin(as_rows(docs)) > 0) == (y > 0))
    assert right(w, v, b) > 0.95 and right(w, 0 * v, b) < 0.8 and v[0] @ v[1] > 1


def test_calibration():
    rng = np.random.default_rng(1)
    m = rng.normal(0, 2, 5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(1.5 * m - 1)))).astype(float)
    k, c = toxicity.calibrated(m, y, np.ones(5000))
    assert abs(k - 1.5) < 0.15 and abs(c + 1) < 0.15


def test_urls(spark):
    page = "<html><head><link href='{}' rel='canonical'></head>"
    rows = [
        (1, "http://A.Example.NET/en/x", None), (2, "http://b.net/x", None), (3, "http://c.org/a", page.format("http://b.net/x")), (4, "http://c.org/fr/a", page.format("http://b.net/x")),
        (5, "http://d.org/q#f", page.format("http://c.org/a")), (6, None, None), (7, "nothing", None), (8, "http://example.com/de/", None), (9, "http://x.example.com/de", None),
        (10, "http://e.org/1", '<meta http-equiv="refresh" content="0; url=/2">'), (11, "http://e.org/2", None), (12, "http://g.net", None), (13, "http://netx/", None), (14, "http://h.com/z?a", page.format("http://example.net/en/1")), (2, "http://b.net/x", None),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = urls.judge(df.withColumn("rule", F.lit(1)), urls.links(df), urls.rule_table(spark))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("b.net", "/x", "net/", "block")
    assert got[4] == ("c.org", "/fr/a", "org/fr/", "allow")
    # c.org/a, d.org/q and c.org/fr/a are aliases of b.net/x, and one of them is allowed by a rule
    assert got[3][2:] == (None, "allow") and got[5][2:] == (None, "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow")
    assert got[8][2:] == ("example.com/de/", "block") and got[9][2:] == (None, "allow")
    assert got[12] == ("g.net", "", None, "allow") and got[13][2] is None and got[14][3] == "allow"
    assert out.count() == len(rows)
    import duckdb

    pages = df.toPandas()
    c = duckdb.connect()
    c.register("pages", pages)
    mine = sorted(map(repr, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.select("page_id", "host", "path", F.col("rule"), "verdict").collect())))
    there = c.execute(f"SELECT CAST(page_id AS BIGINT), host, path, rule, verdict FROM ({urls.SQL})").fetchall()
    assert sorted(map(repr, there)) == mine
    few = df.where("page_id NOT IN (4)")
    got = {r.page_id: r.verdict for r in urls.judge(few, urls.links(few), urls.rule_table(spark)).collect()}
    assert got[3] == got[5] == "block" and got[10] == got[11] == "allow"
    none = df.where("page_id < 0")
    assert urls.judge(none, urls.links(none), urls.rule_table(spark)).collect() == []


#: The examples of RFC 3986, section 5.4, that name a place in a hierarchy.
RFC = {
    "g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", "//g": None, "?y": "/b/c/d;p?y", "g?y": "/b/c/g?y", "#s": "/b/c/d;p?q", "g#s": "/b/c/g", ";x": "/b/c/;x", "g;x": "/b/c/g;x",
    "": "/b/c/d;p?q", ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/", "../g": "/b/g", "../..": "/", "../../": "/", "../../g": "/g", "../../../g": "/g", "../../../../g": "/g", "/./g": "/g", "/../g": "/g",
    "g.": "/b/c/g.", ".g": "/b/c/.g", "g..": "/b/c/g..", "..g": "/b/c/..g", "./../g": "/b/g", "./g/.": "/b/c/g/", "g/./h": "/b/c/g/h", "g/../h": "/b/c/h", "g;x=1/./y": "/b/c/g;x=1/y", "g;x=1/../y": "/b/c/y",
    "g?y/./x": "/b/c/g?y/./x", "g#s/../x": "/b/c/g", "http://A/x/../y": None,
}


def test_references_are_resolved(spark):
    df = spark.createDataFrame([("http://a/b/c/d;p?q", t) for t in RFC], "u string, t string")
    got = {r.t: r.n for r in df.select("t", urls.node_of(urls.resolved(F.col("u"), F.col("t"))).alias("n")).collect()}
    want = {t: f"http://a{p}" for t, p in RFC.items()} | {"//g": "http://g/", "http://A/x/../y": "http://a/y"}
    assert got == want
    import duckdb

    con = duckdb.connect()
    for t, n in want.items():
        assert con.execute(f"SELECT {urls._node_sql('u')} FROM (SELECT ? AS u)", [f"http://a{RFC[t]}" if RFC[t] else n]).fetchall() == [(n,)]


def test_links_of_pages(spark):
    link = "<link rel=\"{}\" href='{}'>"
    rows = [
        ("http://a.org/x/", "<!-- " + link.format("canonical", "/no") + " -->" + link.format("alternate canonical", "../yes") + link.format("canonical", "two")),
        ("http://b.org/?q", "<script>'" + link.format("canonical", "/no") + "'</script><META content='0; URL=?z' http-equiv=refresh><link data-rel=canonical href=/no>"),
        ("http://c.org", "<!-- " + link.format("canonical", "/no")), ("http://d.org", None), (None, link.format("canonical", "/no")), ("nothing", link.format("canonical", "/no")),
        ("http://e.org/" + "long/" * 3000, link.format("canonical", "../" * 2999 + "end") + " text" * 200_000),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    got = {(r.a, r.b) for r in urls.links(df).collect()}
    assert got == {("http://a.org/x/", "http://a.org/yes"), ("http://a.org/x/", "http://a.org/x/two"), ("http://b.org/?q", "http://b.org/?z"), (rows[-1][0], "http://e.org/long/end")}


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "ünï"), (None, "http://f/", "same"), (None, "http://g/", "alone"), (1, "http://a/", "same"), (6, "http://h/", "long " * 60_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    folder = str(tmp_path / "w")
    warc.archive(df, folder)
    back = spark.read.format("warc").option("verify", "true").load(folder)
    got = back.collect()
    assert len(got) == len(rows)
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    for r in got:
        key = r.record_id.split(":")[2]
        body = r.payload
        if r.record_type == "response":
            assert warc.base32_sha1(body) == r.payload_digest and len(body) == r.payload_bytes and r.refers_to is None
        else:
            own = next((h or "") for k, _, h in rows if str(k if k is not None else "null") == key and warc.base32_sha1((h or "").encode()) == r.payload_digest)
            assert body is None and r.payload_bytes == len(own.encode()) and r.refers_to == f"urn:page:{first[own]}" and str(first[own]) != key
    assert collections.Counter(r.record_type for r in got) == {"response": 6, "revisit": 3}
    assert len({r.record_id for r in got}) == len(rows) and "urn:page:2" in {r.record_id for r in got}
    some = back.where("record_type = 'revisit'").select("record_id")
    assert some.count() == 3
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.archive(none, str(tmp_path / "e"))
    assert spark.read.format("warc").load(str(tmp_path / "e")).collect() == []


def test_warc_reads_foreign_files(spark, tmp_path):
    """Plain files, and members without the length field, have to be read to be passed."""
    import gzip

    warc.register(spark)
    recs = [warc.record("response", f"urn:page:{k}", "http://x/", "2020-01-01T00:00:00Z", None, warc.base32_sha1(b), b, len(b), "text/html") for k, b in enumerate((b"", b"abc", b"WARC/1.1\r\n\r\n" * 9, bytes(100_000)))]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "p.warc").write_bytes(b"".join(recs))
    (tmp_path / "a" / "q.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    got = spark.read.format("warc").option("verify", "true").load(str(tmp_path / "a")).collect()
    assert sorted(r.payload_bytes for r in got) == [0, 0, 3, 3, 108, 108, 100_000, 100_000]
    one = spark.read.format("warc").load(str(tmp_path / "a")).where("record_id = 'urn:page:2'").collect()
    assert [bytes(r.payload) for r in one] == [b"WARC/1.1\r\n\r\n" * 9] * 2
    bad = bytearray(b"".join(recs))
    bad[bad.index(b"abc")] ^= 1
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "p.warc").write_bytes(bytes(bad))
    with pytest.raises(Exception, match="damaged"):
        spark.read.format("warc").option("verify", "true").load(str(tmp_path / "b")).collect()


def test_cut_records_raise(spark, tmp_path):
    """Wherever a file is cut, with and without verification, and whatever is read of it."""
    import gzip

    warc.register(spark)
    rng = np.random.default_rng(0)
    recs = [warc.record("response", f"urn:page:{k}", "http://x/", "2020-01-01T00:00:00Z", None, warc.base32_sha1(b), b, len(b), "text/html") for k, b in enumerate((b"abc", rng.bytes(50_000)))]
    whole = {"p.warc": recs, "q.warc.gz": [*map(gzip.compress, recs)], "r.warc.gz": [*map(warc.member, recs)], "s.warc.gz": [warc.member(r, 10) for r in recs]}
    for name, parts in whole.items():
        for cut in (5, 60, 200, len(parts[1]) // 2, len(parts[1]) - 2):
            folder = tmp_path / f"{name}-{cut}"
            folder.mkdir()
            (folder / name).write_bytes(parts[0] + parts[1][:cut])
            for verify, payload in (("true", "true"), ("false", "false")):
                reader = warc.WarcReader(str(folder), {"verify": verify, "payload": payload})
                with pytest.raises(warc.Damaged, match=f"at byte {len(parts[0])} "):
                    [list(reader.read(p)) for p in reader.partitions()]
        folder = tmp_path / name
        folder.mkdir()
        (folder / name).write_bytes(b"".join(parts))
        assert [r.payload_bytes for r in spark.read.format("warc").load(str(folder)).collect()] == [3, 50_000]
        (folder / "junk.warc").write_bytes(b"no record")
        with pytest.raises(Exception, match="damaged record"):
            spark.read.format("warc").load(str(folder)).collect()


def test_many_repeated_payloads(spark):
    """The way of a filter, for more repeated payloads than are sent, gives the same rows."""
    rng = np.random.default_rng(3)
    rows = [(int(k) if k % 50 else None, f"p{rng.integers(0, 600)}") for k in range(900)] + [(None, "alone"), (7, None), (8, None)]
    df = spark.createDataFrame(rows, "k bigint, p string").withColumn("p", F.coalesce("p", F.lit("")).cast("binary"))
    with Scratch(spark) as scratch:
        few, many = (sorted(warc.revisits(scratch, df, "k", "p", sent=n).collect(), key=repr) for n in (10**6, 0))
        assert few == many and len(few) == len(rows)
        assert sum(r["__first"] is not None for r in few) > 200


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 20_000, 7).select(F.xxhash64("id").alias("h"))
    got = marked(spark.range(20_000).select("id", F.xxhash64("id").alias("h")), "h", bitmap(keys, "h"), "m").collect()
    assert len(got) == 20_000 and all(r.m for r in got if r.id % 7 == 0) and sum(r.m for r in got if r.id % 7) < 100


def test_cut_archive_raises(spark, tmp_path):
    folder = tmp_path / "w"
    warc.archive(spark.createDataFrame([(1, "http://a/", "x" * 5000)], "page_id bigint, url string, html string"), str(folder))
    own = next(f for f in folder.iterdir() if f.suffix == ".gz")
    own.write_bytes(own.read_bytes()[:-9])
    with pytest.raises(Exception, match="cut or missing"):
        spark.read.format("warc").load(str(folder)).collect()


def test_pushed_filters_agree_with_rows(spark, tmp_path):
    """A uri that looks like a digest or an id is compared as it is."""
    rows = [(1, "sha1:x", "a"), (2, "<b>", "b"), (3, "http://c/", "c"), (4, None, "d")]
    warc.archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "w"))
    back = spark.read.format("warc").load(str(tmp_path / "w"))
    assert {r.target_uri for r in back.collect()} == {"sha1:x", "<b>", "http://c/", None}
    for uri in ("sha1:x", "<b>", "http://c/"):
        assert [r.target_uri for r in back.where(F.col("target_uri") == uri).collect()] == [uri]
    assert back.where("target_uri IS NULL").count() == 1 and back.where("target_uri IN ('sha1:x', '<b>')").count() == 2
    digest = warc.base32_sha1(b"c")
    assert [r.record_id for r in back.where(F.col("payload_digest") == digest).collect()] == ["urn:page:3"]


def cheapest(roles):
    """The cost of a best repair, by the operator's own moves, without its way back."""
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for a, t, k, _, _ in chat.moves(r):
                if a == s:
                    new[t] = min(new.get(t, 1 << 30), c + k)
        best = new
    return min(best.get(s, 1 << 30) for s in chat.ENDS)


def test_costs_equal_an_enumeration():
    """All ways to repair up to three turns: a turn is merged or opens a message, has any role, and an
    empty message of any role may go before it; legal is what the pattern below says."""
    letters, legal_chat = {chat.SYSTEM: "s", chat.USER: "u", chat.ASSISTANT: "a", None: "?"}, re.compile(r"s?u(au)*a?")

    def least(roles):
        best = 1 << 30
        for ways in itertools.product(itertools.product("sua", ["merge", "", "s", "u", "a"]), repeat=len(roles)):
            said, cost = "", 0
            for role, (label, how) in zip(roles, ways, strict=True):
                cost += 2 * (label != role)
                if how == "merge":
                    said, cost = (said if said[-1:] == label else "x"), cost + 1
                else:
                    said, cost = said + how + label, cost + 3 * (how != "")
            if cost < best and legal_chat.fullmatch(said):
                best = cost
        return best

    for n in (1, 2, 3):
        for roles in itertools.product(letters, repeat=n):
            moved = chat.repair(list(roles))
            assert sum(m[2] for m in moved) == least([letters[r] for r in roles]), roles


@pytest.mark.parametrize("text", ["<|user|>", "<~|x", "a <~~| b <| c < | <~ |", "", "plain & <b>", "<" * 5 + "|" * 5, "<~" * 9 + "|"])
def test_escape_is_lossless(text):
    assert "<|" not in chat.escaped(text) and chat.unescaped(chat.escaped(text)) == text


def test_long_texts_and_one_hot_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "word " * 20_000) for t in range(60)] + [(2, 0, "user", "x"), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn string, role string, text string")
    out = chat.format_chats(df, parts=7).collect()
    assert len(out) == 62 and sum(r.cost for r in out) == 2 and all(r.rendered.count("word") == 20_000 for r in out if r.conv_id == 1)


def legal(rows):
    at = chat.START
    for r in rows:
        if r.inserted:
            assert chat.ROLES[r.inserted] in chat.LEGAL[at]
            at = chat.ROLES[r.inserted]
        t = chat.ROLES[r.new_role]
        if "merge" in r.action:
            assert t == at
        else:
            assert t in chat.LEGAL[at]
        at = t
    assert at in chat.ENDS


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_chats_are_repaired_at_least_cost(spark, parts):
    rng = np.random.default_rng(7)
    names = ["user", "assistant", "system", "Human", "GPT", None, "alien"]
    rows = [(k, t, names[rng.integers(0, 7)], f"text {k} {t} <|user|>") for k in range(12) for t in range(int(rng.integers(1, 9)))]
    rows += [(99, t, names[rng.integers(0, 7)], None) for t in range(400)] + [(None, 3, "user", "x"), (None, None, "user", "y"), (5, 0, "user", "again"), (5, 0, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("cost", F.lit("clash"))
    out = chat.format_chats(df, parts=parts).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.conv_id].append(r)
    for key, own in by.items():
        assert [r.turn for r in own] == sorted((r.turn for r in own), key=lambda t: (t is not None, t))
        legal(own)
        assert sum(r.cost for r in own) == cheapest([chat.role_of(r.role) for r in own]), key
        joined = "".join(r.rendered for r in own)
        assert joined.count("<|end|>") == joined.count("<|user|>\n") + joined.count("<|assistant|>\n") + joined.count("<|system|>\n") and joined.endswith("<|end|>\n")
    assert chat.format_chats(df.where("turn < 0"), parts=parts).collect() == []
