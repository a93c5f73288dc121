import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from airspan.llm import linededup
from airspan.llm.linededup import drop_boilerplate, line_sites
from airspan.llm.quality import BAD, GOOD, default_rules, estimate, keep_good, learn, quality


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, twice = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i:i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            twice |= {p + k for p in places for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice))


def texts():
    rng = random.Random(7)
    vocab = ["the", "Haus", "ÉTÉ", "a#b", "$$", "run", "\U0001f600", "of", "x|y", "yes!!", " "] + [f"w{i}" for i in range(300)]
    out = [None, "", "\n \n", "a b c d e f g h " * 3, "x " * 40, "same\nsame\n same\n\tsame\n"]
    for _ in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.4:
            words += words[: rng.randrange(0, 40)]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words))
    return out


def test_statistics_and_verdicts_are_those_by_hand(spark):
    given = list(enumerate(texts()))
    df = spark.createDataFrame(given, "doc_id long, text string")
    found = {r["doc_id"]: r for r in quality(df).collect()}
    for i, text in given:
        r = found[i]
        n, chars, symbols, dup, repeated = statistics(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeated)
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)
    kept = {r["doc_id"] for r in keep_good(df).collect()}
    assert kept == {i for i, r in found.items() if r["kept"]}


def test_estimates_find_each_kind_of_bad_document():
    rules = default_rules()
    clean = tuple(GOOD for _ in rules)

    def bad(*which):
        return tuple(BAD if i in which else GOOD for i in range(len(rules)))
    patterns = [(clean, 9000), (bad(0), 500), (bad(2, 6), 200), (bad(1, 5), 200), (bad(4), 3)]
    trust = estimate(patterns, rules)
    assert abs(trust.share[0] - 0.9) < 0.05 and abs(sum(trust.share) - 1) < 1e-9
    from airspan.llm.quality import _posterior
    p = {votes: _posterior(trust.share, trust.bad, votes)[0] for votes, _ in patterns}
    assert p[clean] > 0.95 and all(p[v] < 0.3 for v, n in patterns[1:4])


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality(docs).join(labels, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1]
    poor = [r["kept"] for r in judged if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.25 * len(poor)


def by_hand(rows, min_sites):
    """Texts vote for one site a class: alone, or with others that have the same common lines beside the one voted on."""
    clean = lambda x: re.sub(r"[\x09-\x0D]", " ", x).strip(" ")
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()[:15]
    seen, site_of, votes = {}, {}, {}
    for _, text, site in rows:
        site_of[text] = min(site_of.get(text, "g"), digest(site or ""))
        for line in (text or "").split("\n"):
            seen.setdefault(clean(line), []).append(site)
    common = {x for x, on in seen.items() if x and len(on) >= min_sites and (len(set(on)) > 1 or min_sites <= 1)}
    for text, site in site_of.items():
        own = {clean(x) for x in (text or "").split("\n")} - {""}
        for line in own & common:
            rest = own - {line}
            shared = sorted(rest & common, key=digest)
            copied = 2 * sum(map(len, shared)) > sum(map(len, rest))
            votes.setdefault(line, {}).setdefault((copied, shared[0] if copied else text), []).append(site)
    sites = {line: len({min(v) for v in classes.values()}) for line, classes in votes.items()}
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if sites.get(clean(x), 0) < min_sites]
        out.append((i, "\n".join(kept), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("min_sites", [1, 2, 10, 12])
def test_lines_of_many_sites_go_and_copies_stay(spark, min_sites):
    rng = random.Random(min_sites)
    sites = [f"site{i}" for i in range(25)] + [None]
    shared = [(f"boiler {k} \t", rng.sample(sites, k)) for k in (1, 2, 9, 10, 11, 12, 25)]
    rows = []
    for i in range(260):
        site = rng.choice(sites)
        lines = [f"own line {rng.randrange(10**9)} of this text, and more words in it" for _ in range(rng.randrange(0, 5))]
        lines += [x for x, on in shared if site in on and rng.random() < 0.9] + rng.choice([[], [""], ["  "]])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), site))
    rows += [(1000 + i, "a whole copied page\nwith two lines", s) for i, s in enumerate(sites)] + [(2000, None, "site1")]
    # Near copies: each has a line of its own in place of one of the page's.
    page = [f"line {k} of a page with many near copies" for k in range(12)]
    for i in range(200):
        words = list(page)
        words[rng.randrange(12)] = f"an edited line {i}"
        rows.append((3000 + i, "\n".join(words), sites[i % len(sites)]))
    # Little of their own beside the boilerplate, and nothing.
    rows += [(4000 + i, f"x{i}\nboiler 25", sites[i]) for i in range(20)] + [(5000, "boiler 25", "site3"), (5001, "boiler 25\n boiler 25", "site4")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in drop_boilerplate(df, min_sites, removed="gone").select("doc_id", "text", "gone").collect()]
    assert sorted(got, key=str) == sorted(by_hand(rows, min_sites), key=str)
    if min_sites == 10:
        left = {i: (text, gone) for i, text, gone in got}
        assert all(left[1000 + i][1] == 0 for i in range(len(sites))) and all(left[3000 + i][1] == 0 for i in range(200))
        assert all(left[4000 + i] == (f"x{i}", 1) for i in range(20)) and left[5000] == ("", 1) and left[5001] == ("", 2)


def test_only_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(f"line{k}\nown {k} {i}", f"s{i}") for k in (99, 100, 101, 300) for i in range(k)] * 2
    df = spark.createDataFrame(rows, "text string, source string")
    found = sorted((r["sites"], r["exact"]) for r in line_sites(df, 100).collect())
    assert [x for x, exact in found if exact] == [100, 101]
    assert len(found) == 3 and abs(found[-1][0] - 300) < 300 * 6 * linededup.ERROR and not found[-1][1]


def test_trust_needs_no_column_but_the_statistics(spark):
    stats = quality(spark.createDataFrame([(1, "a few words")], "doc_id long, text string"))
    assert learn(stats.select(*[F.col(c) for c in stats.columns]), default_rules()).share[0] > 0.5
