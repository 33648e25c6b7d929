"""Document operators against brute force, and on rows of every odd kind."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from accordant.llm import common, html_text, line_dedup, near_docs, secrets, toxicity

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ta", "ri", "mo", "ku", "le", "sa") for b in ("n", "rd", "lk", "st", "ve", "xo", "pi", "gu")]


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def least_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- near duplicates ------------------------------------------------------------------


def word_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def near_truth(texts):
    sets = {i: word_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, least_reachable(ids, links)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return " ".join(out)


@pytest.mark.parametrize("chunk", [256, 7])
def test_near_docs(spark, chunk):
    rng = random.Random(1)
    base = [rng.choice(WORDS) for _ in range(150)]
    texts = {i: edited(rng, base, rng.randint(0, 9)) for i in range(10, 80)}  # one group, not all linked directly
    texts |= {i: " ".join(rng.choice(WORDS) for _ in range(60)) for i in range(80, 100)}
    texts |= {0: None, 1: "", 2: " \n\t", 3: "two words", 4: "Two WORDS", 5: "Äb two", 6: "äb two", 7: texts[10], 8: "w " * 30000}
    rows = [(i, t, True) for i, t in texts.items()] + [(7, texts[7], False), (None, texts[10], False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean").repartition(4)
    got = near_docs.near_docs(docs, chunk=chunk).collect()
    sizes, root = near_truth(texts)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is False
        else:
            assert tuple(r) == (r["doc_id"], sizes[r["doc_id"]], root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])
    assert near_docs.near_docs(docs.limit(0)).count() == 0


def test_near_query(spark):
    texts = documents(spark)
    sizes, root = near_truth(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in contract.queries()["op7_near_docs"](spark, SF).collect()}
    assert got == {i: (sizes[i], root[i]) for i in texts}


def test_miss_probability():
    # The bound keeps a pair at the threshold with all but the miss probability.
    for n in (32, 160):
        least = near_docs.least_matches(n, 0.75, 1e-6)
        rng = np.random.default_rng(n)
        assert (rng.binomial(n, 0.75, 200_000) < least).mean() < 1e-4
        # What is far below is given up, the more surely the more was compared.
        assert (rng.binomial(n, 0.3, 10_000) >= least).mean() < (0.3 if n == 32 else 0.001)


# --- lines ---------------------------------------------------------------------------


BEGINS = re.compile(r"(?s)(?=(.{8}))")


def shingles(line):
    return set(BEGINS.findall(line))


def lines_truth(texts):
    """How many lines of each component there are, by normal form."""
    forms = {}
    for t in texts:
        for line in (t or "").split("\n"):
            form = line.strip(" ").lower()
            if len(form) >= 16:
                forms[form] = forms.get(form, 0) + 1
    names = sorted(forms)
    sets = [shingles(n) for n in names]
    links = [(a, b) for a in range(len(names)) for b in range(a + 1, len(names)) if min(len(sets[a]), len(sets[b])) * 5 >= max(len(sets[a]), len(sets[b])) * 4 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = least_reachable(range(len(names)), links)
    return {n: names[root[i]] for i, n in enumerate(names)}, forms


def check_lines(before, got):
    root, forms = lines_truth(before.values())
    kept = {}
    for doc_id, text, n_lines, n_removed in got:
        if before[doc_id] is None:
            assert text is None and (n_lines, n_removed) == (0, 0)
            continue
        old, new = before[doc_id].split("\n"), text.split("\n")
        assert n_lines == len(old)
        assert n_removed == n_lines - (len(new) if n_removed < n_lines else 0)
        rest = iter(old)
        assert all(line in rest for line in new if n_removed < n_lines)  # in order, unchanged
        for line in new:
            form = line.strip(" ").lower()
            if form in root:
                kept[root[form]] = kept.get(root[form], 0) + 1
    assert kept == dict.fromkeys(root.values(), 1)


def test_short_unspaced_and_odd_lines(spark):
    han = "机器学习模型需要大量干净的文本数据才能学到有用的东西并且回答问题"
    texts = ["=" * 20 + "\n" + "=" * 60, han, han[1:], "one two three four five six seven\none two three four five six seven eight nine ten", "same line, other document", None, "x" * 30000]
    texts += ["same line, other document\n" + "y" * 30000, "\t\t\t" * 9 + "\n" + "\t\t\t" * 9]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[4]), (3, texts[3]), (4, "a different text under an id that is taken")]
    docs = spark.createDataFrame([(*r, "theirs") for r in rows], "doc_id long, text string, n_lines string").coalesce(1)
    out = [(r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()]
    assert len(out) == len(rows) and sum(t is None for t, _ in out) == 1
    left = [line for t, _ in out for line in (t or "").split("\n")]
    assert sum(set(line) == {"="} for line in left) == 1 and sum(line in (han, han[1:]) for line in left) == 1
    assert left.count("same line, other document") == 1 and sum(line.startswith("\t") for line in left) == 1
    assert "a different text under an id that is taken" in left and sum(line.startswith("one two") for line in left) == 2  # too unlike


def test_lines_that_differ_inside_long_words(spark):
    """Every place of a line counts, not only the first characters of its words."""
    lines = ["transaction_0001_ab acknowledged_by_a", "transaction_7394_zy acknowledged_at_z", "one ordinary line of some length that is here twice", "one ordinary line of some length that is here twice."]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(1)
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {0: 0, 1: 0, 2: 0, 3: 1}


def test_close_pairs_of_a_crowd(spark):
    """No pair at the threshold is left out, and a crowd that shares one passage is not paired off."""
    rng = random.Random(5)
    sets = [{*range(60), *(rng.randrange(10**9) for _ in range(40))} for _ in range(300)]
    sets += [set(rng.sample(sorted(s), 100 - k)) | {rng.randrange(10**9) for _ in range(j)} for s in sets[:30] for k, j in ((0, 0), (5, 6), (10, 12), (20, 0))]
    rows = spark.createDataFrame([(i, i, sorted(s)) for i, s in enumerate(sets)], "rep long, root long, s array<long>")
    got = {(r["a"], r["b"]) for r in line_dedup.close_pairs(rows, 80).collect()}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(want) > 60 and want <= got and len(got) < 4 * len(want)


def test_crowded_lines_against_brute_force(spark):
    """Lines that share a passage, and near copies of one line, in crowded bands."""
    rng = random.Random(9)
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    lines = [f"{passage} {' '.join(rng.choice(WORDS) for _ in range(rng.randint(3, 14)))}" for _ in range(120)]
    lines += [edited(rng, passage.split(), rng.randint(1, 3)) for _ in range(60)]
    texts = dict(enumerate(lines))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    check_lines(texts, [tuple(r) for r in line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed").collect()])


def test_crowd_round_its_commonest_line(spark, monkeypatch):
    """Variants too unlike each other, but like the line they were made from, are not compared with each other."""
    rng = random.Random(3)
    words = [f"{rng.choice(WORDS)}{i}" for i in range(60)]
    base, lines = " ".join(words), []
    for i in range(50):
        at = rng.sample(range(60), 2)
        lines.append(" ".join(f"qqqq{i}z{j}" if j in at else w for j, w in enumerate(words)))
    assert all(100 * len(shingles(a) & shingles(base)) >= 80 * len(shingles(a) | shingles(base)) for a in lines)
    assert sum(100 * len(shingles(a) & shingles(b)) < 80 * len(shingles(a) | shingles(b)) for a in lines for b in lines) > 1000
    texts = dict(enumerate([*lines, base, base, base]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    crowd, plain = [], line_dedup.close_pairs
    monkeypatch.setattr(line_dedup, "close_pairs", lambda nodes, percent: (crowd.append(nodes.count()), plain(nodes, percent))[1])
    check_lines(texts, [tuple(r) for r in line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed").collect()])
    assert crowd == [0]


def test_texts_of_lines_kept(spark, monkeypatch):
    """Only texts of lines that may resemble another are written down, and signatures of all are gone before these are compared."""
    rng = random.Random(4)
    lines = [" ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(200)]
    texts = dict(enumerate([*lines, f"{lines[0]} x", "\n".join(lines[:9])]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    kept, seen = [], []
    keep, cluster = line_dedup.keep, line_dedup.cluster

    def noted(df, name, *codec):
        kept.append((name, keep(df, name, *codec)))
        return kept[-1][1]

    def compared(*args, **options):
        seen.extend((name, t.count()) for name, t in kept if "line" in t.columns)
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            dict(kept)["signed"].count()
        return cluster(*args, **options)

    monkeypatch.setattr(line_dedup, "keep", noted)
    monkeypatch.setattr(line_dedup, "cluster", compared)
    check_lines(texts, [tuple(r) for r in line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_removed").collect()])
    assert seen == [("nodes", 2)]


def test_shuffled_rows_go_once_a_table_is_kept(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, cleanup = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    counts = spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").agg(F.sum("id").alias("s"))
    both = common.keep(counts.join(counts.withColumnRenamed("s", "t").hint("merge"), "k"), "sums")
    alone = common.keep_alone(spark, "alone", lambda: both.groupBy("k").agg(F.max("s").alias("s")))
    waited = time.time() + 20
    while shuffled() - before and time.time() < waited:
        time.sleep(0.2)
    assert not shuffled() - before and spark.conf.get(cleanup) == "false"
    assert alone.count() == counts.count() == 7 and both.where("s = t").count() == 7


def test_minima_of_whole_lines(spark):
    """Every place of a line is read, the last ones as well, whatever the width of its characters."""
    text = "äé😀机器学习 one two, drei; vier ... 😀😀 twenty-three and some more"
    lines = spark.createDataFrame([(n, text[:n]) for n in range(6, len(text) + 1)] + [(8, text[:8])] + [(100 + n, text[-n:]) for n in range(6, 30)], "h long, line string")
    got = {r["h"]: (r["n"], r["m0"], r["m1"]) for r in line_dedup.minima(lines, 8, line_dedup.POINTS[:2]).collect()}
    cut = lines.select("h", F.explode(F.regexp_extract_all("line", F.lit("(?s)(?=(.{8}))."), F.lit(1))).alias("s")).select("h", F.hash("s").alias("x"))
    want = cut.groupBy("h").agg(*(F.min(F.col("x").bitwiseXOR(F.lit(p))).alias(f"m{i}") for i, p in enumerate(line_dedup.POINTS[:2]))).collect()
    assert got == {r["h"]: (1 + (r["h"] == 8), r["m0"], r["m1"]) for r in want}


def test_recall_of_linked_lines():
    """Of linked pairs, the share that a band proposes and the signature lets pass."""
    rng = random.Random(11)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 60))) for _ in range(1500)]
    hashed, linked, met = {}, 0, 0

    def signed(line):
        if line not in hashed:
            xs = np.array([zlib.crc32(s.encode()) for s in shingles(line)], np.int64)
            hashed[line] = np.array([(xs ^ p).min() for p in line_dedup.POINTS[:21]])
        return hashed[line]

    for line in base:
        words = line.split()
        for _ in range(2):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            other = " ".join(words)
            a, b = shingles(line), shingles(other)
            if len(other) >= 16 <= len(line) and other != line and 100 * len(a & b) >= 80 * len(a | b):
                same = (signed(line) == signed(other)).reshape(7, 3)
                linked += 1
                met += bool(same.all(axis=1).any())
    assert linked > 500 and met / linked >= 0.99


def test_line_query_against_brute_force(spark):
    import __spark_entry__ as contract

    sf = "/root/testdata/sf0.001"
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_lines(before, [tuple(r) for r in contract.queries()["op6_line_dedup"](spark, sf).select("doc_id", "text", "n_lines", "n_removed").collect()])


def test_lines(spark):
    rng = random.Random(2)
    base = " ".join(rng.choice(WORDS) for _ in range(40))
    near = [base.replace(f" {w} ", " zz ", 1) for w in sorted(set(base.split()))[:6]]
    texts = {0: None, 1: "", 2: "short\n\nshort", 3: f"{base}\nown line of three", 4: f"  {base.upper()} \n\n{near[0]}\nshort", 5: near[1], 6: f"{near[2]}\n{near[2]}", 7: "x" * 50 + "\n" + "x" * 49, 8: "\n".join(" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(300))}
    docs = spark.createDataFrame([(i, t, "old") for i, t in texts.items()], "doc_id long, text string, n_removed string").coalesce(1)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    check_lines(texts, [tuple(r) for r in out.collect()])
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0




# --- secrets -------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


ODD = [
    None, "", "é😀 token = abcdef", "token=abc password: token: abcdef1", "PASSWORD'='a.b=c/d+e", "secret:ab\nsecret=abcdefg",
    "AKIA" + "A" * 15 + " AKIA" + "B1" * 8, "token=" + "0123456789abcdef" * 2, "a" * 24 + "g" + "b" * 23, "api_key= \"ABCDEF12\" apikey:zzzzzz",
    "ghp_" + "aB3" * 12, "Zx9" * 12 + " tail", "x " * 20000 + "passwd:qwerty1",
]


def test_secrets(spark):
    docs = spark.createDataFrame([(i, t, f"s{i}", 1) for i, t in enumerate(ODD)], "doc_id long, text string, source string, findings int")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    for i, t in enumerate(ODD):
        spans = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, spans, got[i])
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))
        assert set(spans) <= set(filter(None, got[i]["spans"].split(",")))
    assert "provider:0:40" in got[10]["spans"] and "mixed:0:36" in got[11]["spans"]
    assert secrets.scan(docs.limit(0)).count() == 0


def test_copied_values_are_examples(spark):
    rows = [(i, "token = copied_value_1", f"owner{i}") for i in range(6)] + [(9, "say token = only_mine_77 twice", None), (10, None, "owner1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    live = {r["doc_id"]: r["n_live"] for r in secrets.digest(secrets.scan(docs)).collect()}
    assert live == {i: 0 for i in range(6)} | {9: 1, 10: 0}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean == {i: "token = copied_value_1" for i in range(6)} | {9: "say [secret] twice", 10: None}


def test_one_owner_in_many_documents(spark):
    key, long = "ghp_" + "aB3" * 12, "Zx9" * 100
    rows = [(i, f"use {key} or token=only_mine_77", "hot", f"r{i}") for i in range(60)] + [(99, f"a {long} b", "own", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repository string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(docs)).collect()}
    assert all(got[i]["spans"] == "provider:4:44,mixed:4:44,assign:48:66" and got[i]["n_live"] == 3 for i in range(60))
    assert (got[99]["spans"], got[99]["n_live"]) == ("mixed:2:302", 1)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert clean == {i: "use [secret] or [secret]" for i in range(60)} | {99: "a [secret] b"}
    named = secrets.digest(secrets.scan(docs, repository_col="repository")).where("doc_id < 60")
    assert {(r["spans"], r["n_live"]) for r in named.collect()} == {("assign:48:66", 0)}


def test_secrets_query(spark):
    texts = documents(spark)
    got = {r["doc_id"]: r["base_sha256"] for r in contract.queries()["op10_secrets"](spark, SF).collect()}
    assert got == {i: hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest() for i, t in texts.items()}


# --- pages ---------------------------------------------------------------------------

PAGES = {
    None: "",
    "": "",
    "plain   words\n only": "plain words only",
    "<p>a &amp;&lt;b</p><p> c&nbsp;d </p>": "a &<b c d",
    "<html><head><title>no</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>menu</a></ul></nav>"
    "<article><h1>Head</h1><p>one <b>bo</b>ld<br>two</p><!-- no --><aside>side</aside><form>f</form><p>x.</p></article>"
    "<div class='comments'><p>first! i like this a lot, thanks</p></div><footer>foot</footer>": "Head one bold two x.",
    "<article><p>never closed <nav>one<p>last": "never closed one last",
    "<div class=\"sidebar left\">aa bb cc</div><main><p>body text here</p></main>": "body text here",
}


def test_pages(spark):
    weights = html_text.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    assert all(w >= 0.05 if n.startswith("w ") else w <= -0.05 for n, w in weights.items())
    rows = [(i, "u", h, "clash") for i, h in enumerate(PAGES)]
    pages = spark.createDataFrame(rows + rows[3:4], "page_id long, url string, html string, text string")
    got = html_text.extract(pages, weights).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert r["text"] == list(PAGES.values())[r["page_id"]], r
        assert r["n_chars"] == len(r["text"])
    assert html_text.extract(pages.limit(0)).count() == 0


WRAPPERS = ["site no-sidebar", "layout with-sidebar", "content-footer", "search-results", "ad-free", "social-science", "page has-banner"]


@pytest.mark.parametrize("name", WRAPPERS)
def test_wrappers_are_not_hidden(name):
    body = "<p>" + " ".join(WORDS[:40]) + "</p>"
    menu, notes = '<div class="menu"><a href=x>one</a> <a href=y>two</a></div>', f'<div class="comments"><p>{" ".join(WORDS[:30])}</p></div>'
    for inside in (f"<article>{body}</article>", body):
        for attribute in ("class", "id"):
            page = f'<html><body>{menu}<div {attribute}="{name}">{inside}</div></body></html>'
            assert html_text.main_text(page, {}) == " ".join(WORDS[:40]), page
    page = f'<html><body>{menu}<div class="{name}"><article>{body}</article>{notes}</div></body></html>'
    assert html_text.main_text(page, {}) == " ".join(WORDS[:40])
    assert html_text.main_text(f"<form><main>{body}</main></form>", {}) == " ".join(WORDS[:40])


@pytest.mark.parametrize("junk", ["<a ", "<a href=\"", "<script ", "<! ", "<div class='x ", "<p>", "</div>", "<!--", "&"])
def test_a_million_characters_of_open_tags(junk):
    start = time.perf_counter()
    text = html_text.main_text("<p>first words of a page</p>" + junk * (1_000_000 // len(junk)), {})
    assert time.perf_counter() - start < 20 and isinstance(text, str)


def test_pages_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in contract.queries()["op4_html_text"](spark, SF).collect():
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", pages[r["page_id"]], re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", article)]
        assert r["text"] == " ".join(b for b in blocks if b)


def test_best_stretch():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_stretch(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[a:b]) == max(best, 0)


# --- toxicity ------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    odds, move = np.exp(rng.normal(size=(1, 6))), np.exp(rng.normal(size=(2, 2)))
    total, toxic = 0.0, np.zeros(6)
    for path in range(64):
        tags = [path >> t & 1 for t in range(6)]
        weight = np.prod([odds[0, t] for t in range(6) if tags[t]]) * np.prod([move[a, b] for a, b in zip(tags, tags[1:])])
        total += weight
        toxic += weight * np.array(tags)
    assert np.allclose(toxicity._marginals(odds, move)[2][0], toxic / total)
    padded = np.concatenate([odds, np.zeros((1, 3))], 1)
    assert np.allclose(toxicity._marginals(padded, move, np.array([5]))[2][0, :6], toxic / total)


def test_toxicity_learns(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(40)] = "vile" + rng.choice(["", "ly", "ness", "st"])
        rows.append((i, " ".join(words), "en", 0.5))
        labels.append((i, int(bad)))
    rows += [(1000, None, "en", 0.5), (1001, "", None, None), (1002, "You VILEST, 'vile' one", "en", 0.1), (1002, "fine", "en", 0.1), (None, "vile", "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    told = spark.createDataFrame([*labels, (5000, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, told)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all((by_id[i]["score"] >= 0.3) == bool(t) for i, t in labels)
    assert by_id[1000]["score"] == by_id[1001]["score"] < 0.1 and by_id[1000]["spans"] == []
    spans = next(r["spans"] for r in got if r["doc_id"] == 1002 and r["spans"])
    assert (spans[0]["start"], spans[0]["end"]) == (4, 17)
    kept = toxicity.below(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == 480 + 2 + 1
    assert toxicity.score(docs, toxicity.Model.untrained()).where("score > 0.1").count() == 0
    assert toxicity.train(docs, told.limit(0)).slope == 0


def test_toxicity_query(spark):
    rows = contract.queries()["op8_toxicity"](spark, SF).collect()
    texts = documents(spark)
    import zlib

    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
