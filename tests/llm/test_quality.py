import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    words = WORD.findall(text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for places in seen.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_figures_equal_brute_force(docs, rows):
    got = quality.figures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *figures(r[1]))) for r in rows)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 50, 0.05), (3, 700, 0.0125), (40, 5000, 0.0125), (0, 1, 0.5), (30, 20, 0.1), (100, 400_000, 0.001)])
def test_binomial_bound_is_exact(spark, k, n, p):
    got = spark.range(1).select(quality.log_binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(min(k, n) + 1)]
    want = 0.0 if k >= n * p else max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))
    assert got == pytest.approx(want, abs=1e-6)


def _labelled(spark, n, bad_every, good_high):
    schema = "doc_id long, stratum string, copy string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    rows, labels = [], []
    for i in range(n):
        bad = i % bad_every == 0
        symbols = 200 if bad else 15 if i % 1000 < good_high else 0
        rows.append((i, "a" if i % 2 else "b", hashlib.md5(str(i).encode()).hexdigest(), 100, 500, symbols, 5, 0, 0))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int")


def test_cutoffs_limit_false_rejections(spark):
    rows, labels = _labelled(spark, 4000, 10, 30)  # 3 % of the good documents have 0.15 symbols a word
    got = {r["stratum"]: r.asDict() for r in quality.cutoffs(rows, labels).collect()}
    # Cutoffs below 0.15 would lose 3 %; above, all low-quality documents go and no good one: of
    # those the loosest is taken. Stratum a has no low-quality label and so nothing to gain.
    assert set(got) == {"b"}
    assert got["b"]["cutoff_symbols_per_word"] == 1.0
    assert got["b"]["cutoff_mean_word_length"] is None


def test_a_rule_that_loses_too_many_good_documents_is_not_admitted(spark):
    rows, labels = _labelled(spark, 4000, 10, 300)
    rows = rows.withColumn("n_symbols", F.when(F.col("n_symbols") == 15, 200).otherwise(F.col("n_symbols")))
    assert quality.cutoffs(rows, labels, cost=0.1).count() == 0
    assert quality.cutoffs(rows, labels, cost=0.1, alpha=0.5).count() == 1


def test_few_labels_admit_nothing(spark):
    rows, labels = _labelled(spark, 200, 10, 0)
    assert quality.cutoffs(rows, labels).count() == 0


def test_copies_count_once(spark):
    rows, labels = _labelled(spark, 1200, 10, 0)
    assert quality.cutoffs(rows, labels).count() == 1
    few = rows.withColumn("copy", F.md5(F.pmod("doc_id", F.lit(100)).cast("string")))
    assert quality.cutoffs(few, labels).count() == 0


def slow_cutoffs(docs, labels):
    """stratum -> [(rule, cutoff)] in force, from (doc_id, text, lang) and {doc_id: quality}."""
    strata = {}
    for i, text, lang in docs:
        n, chars, symbols, dup, again = figures(text)
        if i in labels and not (n < 20 or 100 * again > 30 * n):
            lines = sum(1 for x in text.split("\n") if WORD.search(x))
            rates = {"symbols_per_word": symbols / n, "duplicate_line_share": dup / lines, "repeated_word_share": again / n, "mean_word_length": chars / n}
            key = hashlib.md5(text.encode()).hexdigest()
            old = strata.setdefault(lang, {}).get(key)
            strata[lang][key] = (min(labels[i], old[0]) if old else labels[i], rates)
    picked = {}
    for lang, seen in strata.items():
        part = [v for k, v in seen.items() if int(k[0], 16) < quality.CHOOSING]
        good, bad = max(1, sum(q for q, _ in part)), max(1, sum(1 - q for q, _ in part))
        best = []
        for place, (rule, cutoffs) in enumerate(quality.RULES.items()):
            over = lambda q, c, rule=rule, part=part: sum(x == q and r[rule] > c for x, r in part)
            balance, cutoff = max((over(0, c) / bad - quality.COST * over(1, c) / good, c) for c in cutoffs)
            if balance > 0:
                best.append((-balance, place, rule, cutoff))
        if best:
            picked[lang] = [(r, c) for *_, r, c in sorted(best)]
    out = {}
    for lang, chain in picked.items():
        good = [r for k, (q, r) in strata[lang].items() if int(k[0], 16) >= quality.CHOOSING and q == 1]
        for j in range(1, len(chain) + 1):
            k = sum(any(r[rule] > c for rule, c in chain[:j]) for r in good)
            p = sum(math.comb(len(good), i) * quality.ALPHA**i * (1 - quality.ALPHA) ** (len(good) - i) for i in range(k + 1))
            if p > quality.DELTA / len(picked):
                break
            out[lang] = chain[:j]
    return out


def labelled_documents():
    """Two strata with labels enough, one with too few, one without; junk by symbols, by
    repeated lines and by long words; some of it good; copies."""
    rng, rows, labels = random.Random(11), [], {}
    for i in range(1400):
        lang = ["en", "de", "en", "de", None, "fr"][i % 6] if i < 1200 else "es"
        lang = "en" if lang == "fr" and i > 90 else lang
        bad = rng.random() < 0.25
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.randint(25, 60))]
        kind = rng.randrange(3) if bad or rng.random() < 0.01 else None
        if kind == 0:
            words = [w + "##" for w in words]
        if kind == 1:
            words += ["\n".join(["again and once more"] * 3)] * 2
        if kind == 2:
            words = [w * 6 for w in words]
        text = " ".join(words)
        rows.append((i, text, lang))
        labels[i] = 0 if bad else 1
    rows += [(2000 + i, rows[7][1], "en") for i in range(60)]
    return rows, labels | {2000 + i: labels[7] for i in range(60)}


@pytest.fixture(scope="module")
def judged_rows(spark):
    rows, labels = labelled_documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    return rows, labels, quality.judged(docs, told).collect()


def test_documents_are_rejected_as_by_brute_force(judged_rows):
    rows, labels, got = judged_rows
    force = slow_cutoffs(rows, labels)
    assert len(force) >= 2 and "fr" not in force
    assert any(len(x) > 1 for x in force.values())
    texts, rejected = {i: (t, lang) for i, t, lang in rows}, 0
    for r in got:
        text, lang = texts[r["doc_id"]]
        n, chars, symbols, dup, again = figures(text)
        lines = sum(1 for x in text.split("\n") if WORD.search(x))
        rates = {"symbols_per_word": symbols / n, "duplicate_line_share": dup / lines, "repeated_word_share": again / n, "mean_word_length": chars / n}
        want = sorted(rule for rule, c in force.get(lang, []) if rates[rule] > c)
        assert sorted(r["rejected_by"]) == want
        assert r["kept"] == (not r["base_failed"] and not want)
        rejected += bool(want)
    assert rejected > 100


def test_verdicts(docs, empty, spark):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels)
    assert got.count() == docs.count()
    assert got.where("kept = base_failed").count() == 0
    assert quality.judged(empty, labels).count() == 0
    assert quality.judged(docs, labels.limit(0)).where("kept <> (NOT base_failed)").count() == 0
