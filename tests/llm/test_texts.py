"""PII, quality rules, language, toxicity, quality and decontamination on small fixtures."""

import random
import zlib

import brute
import pytest

from sparkloom.llm import decontamination, language_id, pii, quality_gam, quality_rules, toxicity, url_filter

SF = "/root/testdata/sf0.001"
TRICKY = [
    None, "", " \n ", "a@b.c_d@e.f x..y@z-1.co.uk. @x a@ b@c", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.4 1.2.3 256.0.0.1",
    "10.0.0.1 192.168.0.1, 127.0.0.1; 0.0.0.0 000.1.2.3 00.00.00.00 1.2.3.0256 0255.0.0.0",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005", "+1 (988) 555-2485, +44 20 7946 0958. +1 2 +12345678901234567",
    "é@ü.de naïve.é+x@mail.example.com 😀 +49 (0)30 123456", "a@" + "b." * 3000 + "c", "1" * 5000, "1." * 3000, "a" * 20000 + "@", "mail a@b.cd,a@b.cd;+123456789\n+1234\n56789",
]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_base_spans_are_those_of_the_contract(spark):
    rows = list(enumerate(TRICKY))
    found = {r.doc_id: r for r in pii.find(frame(spark, rows)).collect()}
    for k, text in rows:
        r = found[k]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute.pii(text), text


def test_terms_that_disclose_an_entity(spark):
    rnd = random.Random(1)
    filler = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30))
    rows = [(k, f"{filler()} Zanzibar office mail chief@corp.example or call {filler()}") for k in range(5)] + [(k, filler() + " office") for k in range(5, 60)]
    found = {r.doc_id: r.spans for r in pii.find(frame(spark, rows)).collect()}
    text = rows[0][1]
    at = text.index("Zanzibar")
    assert f"term:{at}:{at + 8}" in found[0] and "email:" in found[0]
    assert "term" not in found[20]
    clean = {r.doc_id: r.text for r in pii.sanitise(frame(spark, rows)).collect()}
    assert "[TERM] office" in clean[0] and "chief@corp" not in clean[0] and clean[20] == rows[20][1]


def test_sanitise_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame([(k, t, "k") for k, t in [*enumerate(TRICKY), (None, "x@y.zz"), (3, TRICKY[3])]], "doc_id long, text string, _base string")
    docs = docs.withColumnRenamed("_base", "spans")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert not any("@example" in (r.text or "") or "555-2485" in (r.text or "") for r in out.collect())
    assert pii.sanitise(docs.limit(0)).count() == 0 and pii.find(docs.limit(0)).count() == 0


def test_counts_are_those_of_the_contract(spark):
    rnd = random.Random(2)
    rows = [(k, t) for k, t in enumerate([None, "", "a b", "a b c a b c", "x\ny\nx\n \n\nx", "# $ |", "the cat " * 40_000, *[" ".join(rnd.choice(["a", "b", "c#", "d\n"]) for _ in range(rnd.randint(1, 90))) for _ in range(60)]])]
    for r in quality_rules.statistics(frame(spark, rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.counts(rows[r.doc_id][1])


def test_decision_list_finds_planted_rules():
    rnd = random.Random(3)
    rows = []
    for _ in range(3000):
        x = tuple(rnd.random() for _ in range(4))
        rows.append((x, int(not (x[0] > 0.8 or (x[1] < 0.2 and x[2] > 0.5)))))
    rules = quality_rules.learn_list(rows)
    judged = [(not any(all(quality_rules._holds(x, c) for c in r) for r in rules), y) for x, y in rows]
    assert sum(a == bool(b) for a, b in judged) / len(rows) > 0.95
    assert quality_rules.learn_list([]) == [] and quality_rules.learn_list([((1.0,), 1)] * 50) == []


def tables(spark):
    return [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")]


def edge_rows(docs):
    """Nulls, empty and very long texts, repeated rows and columns that clash with results."""
    spark = docs.sparkSession
    odd = spark.createDataFrame([(None, "a text of no id", "en"), (9001, None, None), (9002, "", "en"), (9003, "12 34 !?", "fr"), (9004, "long " * 60_000, "en"), (9004, "long " * 60_000, "en")], "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    return docs.select("doc_id", "text", "lang").limit(60).unionByName(odd).withColumns({"score": F.lit("s"), "n_words": F.lit(None).cast("int"), "term": F.lit(1), "y": F.lit(2)})


def test_language_is_found_on_held_out_documents(spark):
    docs, _, _ = tables(spark)
    profiles = language_id.learn(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language_id.identify(docs, profiles).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) / len(rows) > 0.95
    odd = {r.doc_id: r for r in language_id.identify(edge_rows(docs), profiles).collect()}
    assert odd[9001].lang_pred == odd[9002].lang_pred == odd[9003].lang_pred == "und" and 0 <= odd[9004].score <= 1
    kept = language_id.accepted(edge_rows(docs), profiles)
    assert kept.columns == edge_rows(docs).columns and not {9001, 9002, 9003} & {r.doc_id for r in kept.collect()}
    assert language_id.identify(docs, {}).where("lang_pred != 'und'").count() == 0
    assert language_id.learn(docs.limit(0)) == {}


def levenshtein_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def test_automaton_matches_within_one_edit():
    rnd, entries = random.Random(4), ["moron", "stupid", "scum", "morons"]
    automaton = toxicity.Automaton(entries, ["lowe"])
    for _ in range(4000):
        word = list(rnd.choice([*entries, "lowex"]))
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(len(word) + 1)
            word[k : k + rnd.randint(0, 1)] = rnd.choice(["", "m", "s", "o"])
        word = "".join(word)
        want = "exact" if word in entries else "stem" if word.startswith("lowe") else "fuzzy" if any(len(e) >= toxicity.FUZZY_LETTERS and levenshtein_one(word, e) for e in entries) else None
        got = automaton.match(word)
        assert (got and got[0]) == want, word


def test_quotation_is_told_from_abuse():
    matcher = toxicity.Matcher(["moron"], [], [])
    abuse, quote, plain = matcher.counts(["you are a moron", 'he said "what a moron" and left', "a fine day"])
    assert abuse[1] == 1 and quote[1] == 0 and quote[4] == 1 and sum(plain[1:]) == 0


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels, "doc_id", "left_semi")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score(docs, labels).collect() if r.held_out]
    clean, toxic = ([r.predicted for r in rows if truth[r.doc_id] == y] for y in (0, 1))
    assert sum(toxic) / len(toxic) > 0.7 and sum(clean) / len(clean) < 0.05


@pytest.mark.parametrize("operator", [toxicity.score, quality_gam.score, quality_rules.judge])
def test_labelled_operators_on_edge_cases(spark, operator):
    docs, labels, _ = tables(spark)
    edge = edge_rows(docs)
    assert operator(edge, labels).count() == edge.count()
    assert operator(edge, labels.limit(0)).count() == edge.count()
    assert operator(edge.limit(0), labels).count() == 0


def test_quality_model_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels, "doc_id", "left_semi")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in quality_gam.score(docs, labels).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows) > 0.95


def test_benchmark_items_are_found(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    items = [(k, " ".join(word() for _ in range(30)) + ". The answer is " + " ".join(word() for _ in range(4)) + ".") for k in range(20)]
    docs, want = [], set()
    for d in range(120):
        body = [word() for _ in range(rnd.randint(20, 400))]
        if d % 3 == 0:
            k = rnd.randrange(20)
            own = items[k][1].upper().split()
            if d % 2:  # a paraphrase: some words changed, the answer kept
                for _ in range(8):
                    own[rnd.randrange(28)] = word()
            at = rnd.randrange(len(body))
            body[at:at] = own
            want.add((d, k))
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (None, items[0][1])]
    bench = frame(spark, [*items, (50, None), (51, "")], "item_id long, text string")
    table = frame(spark, [(*r, 1) for r in docs], "doc_id long, text string, overlap int")
    found = {(r.doc_id, r.item_id) for r in decontamination.find(table, bench).collect()}
    assert found == want | {(None, 0)}
    kept = decontamination.clean(table, bench)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == ({d for d, _ in docs} - {d for d, _ in want} - {None})
    assert decontamination.find(table.limit(0), bench).count() == 0 and decontamination.find(table, bench.limit(0)).count() == 0


def test_lcs():
    rnd = random.Random(8)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 15))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = _step(row, x, b)
        assert decontamination.lcs(a, b) == row[-1]


def _step(old, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(old[j] + 1 if x == y else max(old[j + 1], new[j]))
    return new


def test_url_rules(spark):
    urls = ["http://A.example.COM/en/71?x", "https://example.com/en/8", "http://x.net/de/1", "http://example.net/de/8#a", "ftp://q.org/es/", "http://net/de/", "nourl", None, "http://", "http://notcom/en/", "http://a.com?/en/"]
    rows = {r.page_id: r for r in url_filter.judge(frame(spark, [(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")).collect()}
    assert [rows[k].rule for k in range(11)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", "net/de/", None, None, None, None, None]
    assert rows[0].host == "a.example.com" and rows[0].path == "/en/71" and rows[6].host == "" and rows[10].path == ""
    assert rows[0].verdict == "allow" and rows[3].verdict == "block"
    empty = frame(spark, [], "page_id long, url string, html string")
    assert url_filter.judge(empty).count() == 0


def test_distrust_flows_to_what_links_to_blocked_hosts(spark):
    page = lambda k, host, *links: (k, f"http://{host}/x", "".join(f'<a class=z href="http://{x}/y">' for x in links))
    rows = [(0, "http://bad.org/es/1", ""), (1, "http://good.net/de/1", '<a href="http://friend.info/">'), page(2, "farm.info", "bad.org"), page(3, "friend.info"), page(4, "alone.info"), page(5, "second.info", "farm.info")]
    found = {r.host: r.verdict for r in url_filter.judge(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert found == {"bad.org": "block", "good.net": "allow", "farm.info": "block", "friend.info": "allow", "alone.info": "allow", "second.info": "block"}


def test_propagation_goes_on_until_it_settles(spark):
    """A chain of hosts longer than any fixed number of rounds, and a circle, against the sums themselves."""
    link = lambda x: f"<a href='http://{x}/y'>"
    rows = [(k, f"http://bad.org/es/{k}", "") for k in range(40)]
    rows += [(100 + k, f"http://h{k}.info/x", link(f"h{k - 1}.info" if k else "bad.org")) for k in range(30)]
    rows += [(200, "http://r0.info/", link("r1.info") + link("h0.info")), (201, "http://r1.info/", link("r0.info"))]
    found = {r.host: r.verdict for r in url_filter.judge(frame(spark, rows, "page_id long, url string, html string")).collect()}
    share = [40 * 0.85 ** (k + 1) / (2 if k else 1) for k in range(30)]  # h1 and r0 link to h0, half each
    assert [found[f"h{k}.info"] for k in range(30)] == ["block" if x >= 0.5 else "allow" for x in share]
    scores = {"h0.info": 40 * 0.85, "r0.info": 0.0, "r1.info": 0.0}
    for _ in range(200):
        # h0 is linked to by h1 and r0 and sends its distrust to both in halves
        scores["r0.info"], scores["r1.info"] = 0.85 * (scores["h0.info"] / 2 + scores["r1.info"]), 0.85 * scores["r0.info"]
    assert {h: found[h] for h in ("r0.info", "r1.info")} == {h: "block" if scores[h] >= 0.5 else "allow" for h in ("r0.info", "r1.info")}


def test_links_of_unclosed_tags_are_found_in_one_scan(spark):
    rows = [*[(10 + k, "http://bad.org/es/1", "") for k in range(4)], (1, "http://one.info/", "<a " * 100_000), (2, "http://two.info/", "<A\nid=1 HREF = 'http://bad.org/y'>" + "<a " * 1000), (3, "http://three.info/", "<a href=>x</a><a id=2><a href=//bad.org/z>")]
    found = {r.host: r.verdict for r in url_filter.judge(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert found == {"bad.org": "block", "one.info": "allow", "two.info": "block", "three.info": "block"}


def test_blocks_of_a_benchmark_find_what_all_pairs_find(spark, monkeypatch):
    """Paraphrases of items in several blocks, with common words left out of the index, against every passage and item."""
    monkeypatch.setattr(decontamination, "BLOCK", 16)
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(3000)]
    word = lambda: vocab[int(3000 * rnd.random() ** 3)]
    items = [(k, " ".join(word() for _ in range(rnd.randint(15, 45))) + "? " + " ".join(word() for _ in range(3))) for k in range(40)]
    docs = []
    for d in range(60):
        body = [word() for _ in range(rnd.randint(30, 200))]
        own = items[rnd.randrange(40)][1].split()
        for _ in range(rnd.randint(0, len(own) // 2)):
            own[rnd.randrange(len(own) - 3)] = word()
        at = rnd.randrange(len(body))
        docs.append((d, " ".join(body[:at] + own + body[at:])))

    def held(text, item):
        words, own, answer = decontamination.words_of(text), decontamination.words_of(item), decontamination.answer_of(item)
        for start in range(0, len(words), decontamination.STEP):
            around = words[max(0, start - len(own)) : start + decontamination.WINDOW + len(own)]
            same = decontamination.lcs(own, around) / len(own)
            if same >= decontamination.EXACT or same >= decontamination.LOOSE and " ".join(answer) in " ".join(around):
                return True
        return False

    want = {(d, k) for d, t in docs for k, x in items if held(t, x)}
    found = {(r.doc_id, r.item_id) for r in decontamination.find(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")).collect()}
    assert found <= want and len(want) >= 45 and len(found) >= 0.95 * len(want)


def test_distrust_reaches_the_end_of_a_long_chain_from_many_seeds(spark, monkeypatch):
    """What stops the rounds doesn't depend on the number of seeds; hubs' edges are dealt to parts."""
    from sparkloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    n, chain = 20_000, 75
    pages = spark.range(n).selectExpr("id AS page_id", "concat('http://bad.org/es/', id) AS url", "'' AS html")
    link = lambda x: f"<a href='http://{x}/y'>"
    rows = [(n + k, f"http://h{k}.info/x", link(f"h{k - 1}.info" if k else "bad.org")) for k in range(chain)]
    rows += [(n + 1000 + k, f"http://s{k}.info/", link("hub.info")) for k in range(40)] + [(n + 2000, "http://hub.info/", "".join(link(f"t{k}.info") for k in range(40)) + link("bad.org"))]
    found = {r.host: r.verdict for r in url_filter.judge(pages.unionByName(frame(spark, rows, "page_id long, url string, html string"))).where("host <> 'bad.org'").collect()}
    # bad.org is linked to by h0 and the hub; each other host of the chain by the next one alone
    share = [n / 2 * 0.85 ** (k + 1) for k in range(chain)]
    assert [found[f"h{k}.info"] for k in range(chain)] == ["block" if x >= 0.5 else "allow" for x in share]
    assert found["hub.info"] == "block" and found["s7.info"] == "block"


def test_contaminated_rows_without_an_own_id_go(spark):
    item = "which of the nine winds carried the copper kettle over the frozen lake at dawn. the answer is the seventh quiet wind."
    rows = [(None, "before " + item + " after"), (None, "a clean text of its own"), (4, item), (4, "another clean text with the same id"), (5, None), (6, "")]
    docs = frame(spark, rows, "doc_id long, text string")
    kept = decontamination.clean(docs, frame(spark, [(1, item)], "item_id long, text string"))
    assert sorted((r.text or "") for r in kept.collect()) == ["", "", "a clean text of its own", "another clean text with the same id"]


def test_no_rows_of_python_values_are_dealt_beside_the_texts(spark, monkeypatch):
    """Such rows go through Python workers of their own, which stay and take an executor's memory."""

    def dealt(*_, **__):
        raise AssertionError("rows of Python values")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", dealt)
    item = "where does the amber river turn beside nine quiet mills under a copper moon"
    docs = spark.range(30).selectExpr("id AS doc_id", f"CASE WHEN id = 3 THEN '{item}' ELSE concat('words of number ', id, ' go on and on') END AS text")
    bench = docs.where("doc_id = 3").selectExpr("doc_id AS item_id", "text")
    assert [(r.doc_id, r.item_id) for r in decontamination.find(docs, bench).collect()] == [(3, 3)]
    assert decontamination.find(docs, bench.limit(0)).count() == 0


def test_index_terms_of_passages_are_met_without_splitting_texts(monkeypatch):
    """Each pass over all texts split them into lists of words, most of its CPU time; only texts of candidates need that."""
    texts = ["", "İstanbul ΑΣ ΑΣ'ς x_1", "\n\n", "a", "日本語 text Ⅷ ²x", "a\x00b \x1cc d Σ", "tail_ " + "alpha beta, gamma! " * 90, "straße\tÉcole é " * 40, "beta\n" * 49]
    words = [decontamination.words_of(t) for t in texts]
    terms = {w: k for k, w in enumerate(sorted({w for own in words for w in own[:7]} - {"gamma"}) + ["absent"])}
    rows, begins, n = [], [], 0
    for own in words:
        begins.append(n)
        for start in range(0, max(1, len(own) - decontamination.STEP), decontamination.STEP) if own else []:
            some = [terms[w] for w in own[start : start + decontamination.WINDOW] if w in terms]
            rows += [(n, t, some.count(t)) for t in sorted(set(some))]
            n += 1

    def split(_):
        raise AssertionError("a text was split into words")

    monkeypatch.setattr(decontamination, "words_of", split)
    for known in (terms, {}):
        passage, term, count, first, total = decontamination.Passages(known)(texts)
        assert list(zip(passage.tolist(), term.tolist(), count.tolist(), strict=True)) == (rows if known else [])
        assert (first.tolist(), total) == (begins, n)
