import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import hamming_topk, html_text, language_profiles, licence_scan, mixing, near_dedup, packing, quality_rules, toxicity, url_rules
from reelspark.llm.shared import local_rows

TEXTS = [(1, "the cat sat on the mat and it was good"), (2, None), (3, ""), (4, "  \n\t "), (5, "der hund und die katze sind nicht hier"), (5, "der hund und die katze sind nicht hier"), (None, "lonely row here now"), (6, "word " * 30_000)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "a" if i else None) for i, t in TEXTS], "doc_id long, text string, n_words string, source string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://Www.Example.NET/en/1?q", "ftp://example.com/de/", "http://x.org/fr/a#b", "http://x.org/fr", "no scheme", None, "http://net", "http://xnet/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for limit in (100_000, 0):  # broadcast, and the salted way beyond it
        got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(pages, local_rows(spark, url_rules.RULES), ["page_id"], broadcast_rows=limit).collect()}
        assert [got[i] for i in range(9)] == [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), *[(None, "allow")] * 5]
    assert url_rules.judge(pages.where("false"), local_rows(spark, url_rules.RULES), ["page_id"]).count() == 0


def test_url_rules_keep_repeated_rows_and_clashing_names(spark):
    rows = [(1, "http://a.net/x", "own", "r"), (1, "http://a.net/x", "own", "r"), (2, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, k0 string")
    got = url_rules.judge(pages, local_rows(spark, url_rules.RULES), ["page_id", "host", "k0", "url"])
    assert got.columns == ["page_id", "host_input", "k0", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect())) == [(1, "own", "r", "http://a.net/x", "a.net", "/x", "net/", "block")] * 2 + [(2, None, None, None, "", "", None, "allow")]


def brute_repeat(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({p + j for at in seen.values() if len(at) > 1 for p in at for j in range(3)})


def test_quality_rules(spark, docs, empty):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcdef"), n)) for n in (2, 3, 4, 5, 60, 400)] + ["a b c a b c", "x\nx\n\nx", None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.judge(frame, ["doc_id"]).collect():
        words = (texts[r.doc_id] or "").split()
        assert (r.n_words, r.n_repeat_words, r.word_chars) == (len(words), brute_repeat(words), sum(map(len, words)))
    assert quality_rules.judge(empty, ["doc_id"]).count() == 0


PROSE = [" ".join(f"word{k}x{i}" for i in range(30)) + "." for k in range(4)]


def test_quality_rules_remove_failing_lines(spark):
    import corpus_pipeline

    text = "\n".join(["Home | News | Sport | More", PROSE[0], "Click here now.", PROSE[1], "", "  ", PROSE[2], PROSE[0], "# * $ %", PROSE[3]])
    want = "\n".join(PROSE[:2]) + "\n\n" + "\n".join(PROSE[2:])
    frame = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "Menu | a | b | c\n" * 60 + PROSE[0], "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality_rules.judge(frame, ["doc_id"]).collect()}
    assert (got[1].clean_text, got[1].clean_chars, got[1].line_chars) == (want, sum(map(len, PROSE)), sum(len(x) for x in text.split("\n") if x.strip()))
    assert [tuple(r) for r in corpus_pipeline.quality(spark, frame, "").collect()] == [(1, want, "en", "s", len(want))]


def test_quality_rules_keep_wrapped_prose(spark):
    import textwrap

    english = "the river ran slowly past old houses while people on the bank talked about how many boats had come down from distant hills since morning and whether rain would follow before evening came to town"
    german = "Als der Wagen am Abend durch Stadt und Land nach Hause fuhr, sahen Kinder auf Wiesen Pferde und Schafe, Hunde, Ziegen, Bauern mit Karren, Frauen mit Körben voll Brot, Wein, Käse und Obst vom Markt, Musiker, Soldaten, Reiter, Händler mit Tuch und Seide"
    verse = [f"{a} over hills of {b} and gold," for a in "Wandering Singing Dreaming Calling Sailing Turning".split() for b in "silver amber".split()]
    menu = [f"Section {a} of our website" for a in "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()]
    texts = [*("\n".join(textwrap.wrap(t, w)) + end for t in (english, german) for w in (40, 60) for end in (".", "")[: 2 if t is english else 1]), "\n".join(verse)[:-1] + ".", "\n".join(menu), "\n".join([*menu, PROSE[0]])]
    extra = " ".join(f"more{i}" for i in range(14)) + "."
    frame = spark.createDataFrame([(i, t + "\n\n" + extra if i < 7 else t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(frame, ["doc_id"], min_words=10, most_repeated=100).collect()}
    for i in range(7):
        assert got[i].kept and got[i].clean_text == texts[i] + "\n\n" + extra
    assert got[7].clean_text == "" and got[8].clean_text == PROSE[0]


def test_language(docs, empty):
    train = docs.selectExpr("doc_id", "text", "CASE doc_id WHEN 1 THEN 'en' WHEN 5 THEN 'de' END AS lang")
    got = {(r.doc_id, r.lang_pred) for r in language_profiles.identify(docs, language_profiles.fit(train), ["doc_id"]).collect()}
    assert {(1, "en"), (5, "de"), (2, "und"), (3, "und"), (4, "und")} <= got
    nothing = language_profiles.fit(train.where("false"))
    assert {r.lang_pred for r in language_profiles.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert language_profiles.identify(empty, nothing, ["doc_id"]).count() == 0


def loops_ngrams(text):
    """How often each letter n-gram of one to three characters occurs, words padded with a blank."""
    found = {}
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    joined = " " + " ".join(words) + " " if words else ""
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            g = joined[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                found[g] = found.get(g, 0) + 1
    return found


def test_language_equals_loops(spark):
    rng = np.random.default_rng(8)
    spoken = {k: [f"{a}{b}" for a in heads for b in tails] for k, heads, tails in (("aa", ["the", "wa", "ri"], ["n", "ter", "ver", "s"]), ("bb", ["schö", "über", "ge"], ["n", "ß", "lich", ""]), ("cc", ["él", "ño", "qu"], ["os", "ía", "e", "n"]))}
    rows = [(i, " ".join(rng.choice(spoken[k], 20)) + (" 12." if i % 2 else "!"), k) for i, k in enumerate(list(spoken) * 12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = 40
    profiles = language_profiles.fit(frame.where("doc_id < 18"), size=size)
    code = lambda g: sum((ord(c) if c != " " else language_profiles.BLANK) << 21 * k for k, c in enumerate(reversed(g)))
    order = lambda counts: sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]
    ranks = {}
    for k in spoken:
        counts = {}
        for _, t, lang in rows[:18]:
            for g, n in (loops_ngrams(t) if lang == k else {}).items():
                counts[g] = counts.get(g, 0) + n
        ranks[k] = {g: r for r, g in enumerate(order(counts))}
    for r in language_profiles.identify(frame, profiles, ["doc_id"]).collect():
        own = order(loops_ngrams(rows[r.doc_id][1]))
        far = {k: sum(abs(ranks[k][g] - i) if g in ranks[k] else size for i, g in enumerate(own)) for k in sorted(spoken)}
        first, second = sorted(far.values())[:2]
        assert r.lang_pred == min(far, key=far.get) and r.score == pytest.approx((second - first) / max(second, 1))


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join([*rng.choice([f"w{k}" for k in range(2000)], 30), *(["vile", "scum"] if i % 2 else [])]), i % 2) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame, frame.where("doc_id < 1700").select("doc_id", "toxic"))
    got = toxicity.score(frame.where("doc_id >= 1700"), model, ["doc_id"]).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs, model, ["doc_id"]).count() == len(TEXTS)
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0
    assert toxicity.fit(frame, frame.where("toxic = 1").select("doc_id", "toxic")) is None
    assert {r.score for r in toxicity.score(docs, None, ["doc_id"]).collect()} == {0.0}


def test_toxicity_takes_one_row_of_a_repeated_id(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join([*rng.choice([f"w{k}" for k in range(300)], 20), *(["vile"] if i % 2 else [])]), i % 2) for i in range(300)]
    again = [(i, f"vile scum {i} {k}", i % 2) for i in range(0, 40, 2) for k in range(6)] + [(2, None, 0), (2, "", 0)]
    schema = "doc_id long, text string, toxic int"
    labels = spark.createDataFrame(rows, schema).select("doc_id", "toxic")
    whole = spark.createDataFrame(rows + again, schema)
    least = whole.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    scores = lambda docs: {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, schema), toxicity.fit(docs, labels), ["doc_id"]).collect()}
    assert scores(whole) == scores(least.repartition(5))


def brute_components(rows, size):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_dedup_equals_brute_force(spark, docs, empty):
    rng = np.random.default_rng(3)
    words, base = [f"w{k}" for k in range(50)], []
    rows = []
    for g in range(6):
        base = list(rng.choice(words, 40))
        for c in range(12):
            own = list(base)
            for at in rng.choice(40, c % 5, replace=False):
                own[at] = "changed" + str(rng.integers(3))
            rows.append((len(rows), " ".join(own)))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "One  two")]
    spec = near_dedup.Spec(shingle=4, lags=1, leaders=1, block=4, piece=3)  # small, so that pieces and blocks have work
    got = {r.id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), spec).collect()}
    assert got == brute_components(rows, 4)
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == len(TEXTS) and {r.component_id for r in found if r.id is None} == {None}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sketch_estimates_similarity():
    with np.errstate(over="ignore"):
        a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(201, 1201, dtype=np.uint64)
        same = (near_dedup.sketch(near_dedup.mixed(a), 288) == near_dedup.sketch(near_dedup.mixed(b), 288)).mean()
        few = near_dedup.sketch(near_dedup.mixed(a[:2]), 288)
    assert abs(same - 800 / 1200) < 0.12 and len(few) == 288


def test_mixing_stays_within_a_block(spark, docs, empty):
    share = mixing.shares({"a": 5.0, "b": 3.0, "c": 1.7}, 97)
    slots = mixing.one_period(share, 97)
    for k, q in share.items():
        for t in range(1, 98):
            assert abs(sum(s < t for s in slots[k]) - q * t / 97) < 1
    frame = spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN null ELSE cast(id % 5 AS string) END AS source")
    got = mixing.mix(frame, ["doc_id"], spec=mixing.Spec(block_rows=4, range_rows=100)).toPandas()
    blocks = got.drop_duplicates("mix_slot")
    assert len(got) == 1000 and sorted(blocks["mix_slot"]) == list(range(len(blocks)))
    assert ((blocks.mix_slot >= blocks.mix_release) & (blocks.mix_slot < blocks.mix_deadline)).all()
    assert mixing.mix(docs, ["doc_id", "text"]).count() == len(TEXTS)
    assert mixing.mix(empty, ["doc_id"]).count() == 0


def test_packing_round_trip(spark, docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rng = np.random.default_rng(9)
    marks = ["don't", "Éa", "naïve,", "x<|y", "<|endoftext|>", "12,5", "straße…", "(a)", "«q»", "\u00a0z", "日本", "e\u0301", "A.B", "!!", "tab\tnew\nline"]
    texts = [t for _, t in TEXTS] + [" ".join(rng.choice(marks, int(rng.integers(1, 40)))) for _ in range(60)] + ["word " * 2047, "a b " * 5000]
    want = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in enumerate(texts)}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (2, 32):
        got = packing.pack(frame, ["doc_id"], path, spec=packing.Spec(open_windows=limit, memory=20)).toPandas()
        for i, own in got.sort_values("start").groupby("doc_id"):
            assert b"".join(own.ids) == want[i] and set(own.doc_tokens) == {len(want[i]) // 4} and list(own.start) == [0, *np.cumsum(own.length)[:-1]]
        assert set(got.doc_id) == set(want) and (got.ids.str.len() == 4 * got.length).all()
        sizes = got.groupby("sequence_id").length.sum()
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        assert sizes.max() <= 2048 and sum(2048 - n for n in sizes if n & (n - 1)) < 0.2 * sizes.sum()
    crc = packing.pack(frame, ["doc_id"], path, derive={"ids_crc32": F.crc32("ids")}).toPandas().sort_values(["doc_id", "start"])
    assert all(r.ids_crc32 == zlib.crc32(want[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) for r in crc.itertuples())
    assert packing.pack(empty, ["doc_id"], path).count() == 0


@pytest.mark.parametrize("may_scan", [True, False])
def test_hamming_equals_brute_force(spark, may_scan):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(300)] + [(1000 + i, [1.0] * 32) for i in range(40)] + [(2000, None), (None, [1.0] * 32), (3000, [1.0] * 16), (4000, [])]
    rows += [(i, rows[i][1]) for i in (0, 0, 0, 7)]
    codes = hamming_topk.sign_codes(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    got = hamming_topk.top_k(codes, codes.where("id % 100 = 0"), hamming_topk.Spec(k=5, block_rows=100, block_queries=3, may_scan=may_scan)).toPandas()
    bits = [(i, np.array(v) > 0) for i, v in rows if i is not None and v is not None]
    for q in (0, 100, 200, 1000, 3000, 4000):
        mine = next(b for i, b in bits if i == q)
        want = sorted((int((mine != b).sum()), i) for i, b in bits if i != q and len(b) == len(mine))[:5]
        assert [(r.distance, r.id) for r in got[got.query_id == q].sort_values("rank").itertuples()] == want
    assert hamming_topk.top_k(codes.where("false"), codes).count() == 0 and hamming_topk.top_k(codes, codes.where("false")).count() == 0


@pytest.mark.parametrize("copies", [2, 6, 30])
def test_hamming_with_repeated_ids(spark, copies):
    rng = np.random.default_rng(copies)
    own, near = rng.normal(size=32), []
    for i in range(1, 60):  # the first segment is the query's, so one lookup meets them and the query's copies
        near.append((i, [float(x) for x in [*own[:16], *rng.normal(size=16)]]))
    rows = [(0, [float(x) for x in own])] * copies + near + near[:3] * 2 + [(1000 + i, [float(x) for x in rng.normal(size=32)]) for i in range(300)]
    codes = hamming_topk.sign_codes(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    got = hamming_topk.top_k(codes, codes.where("id = 0"), hamming_topk.Spec(k=10)).toPandas().sort_values("rank")
    bits = [(i, np.array(v) > 0) for i, v in rows]
    want = sorted((int((bits[0][1] != b).sum()), i) for i, b in bits if i != 0)[:10]
    assert [(r.distance, r.id) for r in got.itertuples()] == want


def test_html(spark):
    page = """<html><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1>
      <p>First   line<br>goes <b>on<p>Second &lt;one&gt;</p><script>var x="</p>";</script><div class=ad>Buy</div></article>
      <section id=comments><p>Much longer reader comment than the article itself has, on and on.</p></section><footer>F</footer></body></html>"""
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", "plain <"), (5, "http://h/5", "<p>" * 20_000)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got == {1: "A & B\n\nFirst line goes on\n\nSecond <one>", 2: "", 3: "", 4: "plain <", 5: ""}


def test_html_without_article(spark):
    lead, more = "<div class=lead><p>" + "lead words " * 30 + "</p></div>", "<div class=more><p>" + "more words " * 10 + "</p></div>"
    menu = "<div><a href=/>Home</a></div>"
    for page in (f"<main>{lead}{more}</main>", f"<body>{menu}<div id=wrap>{lead}{more}</div></body>", f"<section>{lead}{more}</section>"):
        rows = [(i, f"http://h/{i}", page) for i in range(3)]
        want = ("lead words " * 30).strip() + "\n\n" + ("more words " * 10).strip()
        assert [r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()] == [want] * 3


def test_html_vote_overrides_a_page(spark):
    own, side = "<div class=a><p>" + "own words " * 9 + "</p></div>", "<p>" + "side words " * 30 + "</p>"
    rows = [(i, f"http://h/{i}", f"<body>{own}{side if i == 0 else ''}</body>") for i in range(4)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()
    assert [r.text for r in got] == [("own words " * 9).strip()] * 4


@pytest.mark.parametrize(
    "kept",
    ["<div id=content class=has-sidebar>{}</div>", "<article><h2 id=search-results>T</h2>{}</article>", "<article><h2 id=related-work>T</h2>{}</article>",
     "<article><section id=notice-period><h2>Notice period</h2>{}</section></article>", "<div class=promo-layout>{}</div>", "<article>{}<ul><li><a href=/x>T</a></li></ul></article>"],
)
def test_html_keeps_marked_article_text(kept):
    page = html_text.Page("<body><div class=sidebar><p>Side words.</p></div>" + kept.format("<p>" + "own words " * 9 + "</p>") + "<nav><ul><li><a href=/>Home</a></li></ul></nav></body>")
    text = page.text(None)
    assert "own words" in text and ("T" in text or "T<" not in kept) and "Side" not in text and "Home" not in text


def test_html_drops_marked_text():
    page = html_text.Page("<body><article><p>Short.</p></article><div class=related-posts id=related-posts><h2>Related posts</h2><p>x y</p></div><div class=comments><p>" + "far longer " * 30 + "</p></div></body>")
    assert page.text(None) == "Short."


def test_licences(docs):
    scanner = licence_scan.Scanner()
    words = licence_scan.words_of("Intro. Released under the MIT License! x " + licence_scan.TEMPLATES[6][1] + " tail under the MIT license")
    assert scanner.phrases(words) == [(2, "mit"), (len(words) - 4, "mit")]
    assert {scanner.labels[s.template] for s in scanner.spans(words) if s.covered >= 0.75 * scanner.sizes[s.template]} >= {"mit", "gpl"}
    got = licence_scan.scan(docs, ["doc_id", "n_words"])
    assert got.columns == ["doc_id", "n_words_input", "n_words", "base", "spans"] and got.count() == len(TEXTS) and {r.n_words_input for r in got.collect()} == {"x"}
    assert licence_scan.scan(docs.where("false"), ["doc_id"]).count() == 0
    tokens = [0, 1, 2, 1, 2, 3]
    own = licence_scan.Automaton.of([tokens])
    for known in ([1, 2, 3], [2, 1, 2, 3, 9], [0, 0, 1]):
        runs = {tuple(tokens[i:j]) for i in range(6) for j in range(i + 1, 7)}
        want = [max((n for n in range(1, k + 2) if tuple(known[k + 1 - n : k + 1]) in runs), default=0) for k in range(len(known))]
        assert [n for _, n in own.statistics(known)] == want
        for k, (state, n) in enumerate(own.statistics(known)):
            assert not n or own.ends(state) == [(0, j) for j in range(n, 7) if tokens[j - n : j] == known[k + 1 - n : k + 1]]


def test_licence_matches_equal_loops():
    rng = np.random.default_rng(6)
    templates = tuple((f"t{k}", " ".join(rng.choice(list("abc"), 12))) for k in range(4))
    scanner = licence_scan.Scanner(templates, least_match=3)
    known = [t.split() for _, t in templates]
    for _ in range(60):
        words = list(rng.choice(list("abcz"), 25))
        want = set()
        for k, t in enumerate(known):
            for i in range(len(words)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                        n += 1
                    longest = max((m for x in known for y in range(len(x)) for m in [next((m for m in range(min(len(words) - i, len(x) - y), -1, -1) if words[i : i + m] == x[y : y + m]), 0)]), default=0)
                    before = i > 0 and any(words[i - 1 : i + n] == x[y : y + n + 1] for x in known for y in range(len(x)))
                    if n >= 3 and n == longest and not before:
                        want.add((k, j, i, n))
        assert set(scanner.matches([w.encode() for w in words])) == want


@pytest.mark.parametrize("n", [1, 2, 3])
def test_licence_chains_cover_planted_templates(n):
    """A whole template gives one span of its words, also with a few words put in between."""
    scanner = licence_scan.Scanner()
    for k, (label, text) in enumerate(licence_scan.TEMPLATES):
        words = licence_scan.words_of(text)
        cut = len(words) // 2
        broken = [*words[:cut], *[b"zz"] * n, *words[cut:]] if min(cut, len(words) - cut) >= 4 else words
        found = [s for s in scanner.spans([b"qq"] * 3 + broken + [b"qq"]) if s.template == k and s.covered == len(words)]
        assert [(s.first, s.last) for s in found] == [(3, 2 + len(broken))] and scanner.labels[k] == label


def test_licence_query_equals_loops(spark, tmp_path):
    rng = np.random.default_rng(2)
    parts = ["under the MIT License", "Apache License, Version 2", "CC-BY-NC", "plain words", "under the", "mit license", "apache", "cc by", "ncé"]
    rows = [(i, ". ".join(rng.choice(parts, int(rng.integers(1, 9))))) for i in range(80)] + [(90, None), (91, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    got = {r.doc_id: r for r in licence_scan.op8_license_scan(spark, str(tmp_path)).collect()}
    for i, text in rows:
        plain = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in (text or "").lower())
        words = plain.split()
        places = [(at, label) for p, label in phrases.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places)) and r.base_labels == ",".join(sorted({x for _, x in places}))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1) >= bool(places)


@pytest.mark.parametrize("name", ["op6_near_dedup", "op9_url_filters", "op10_quality_rules", "op2_hamming_topk"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from reelspark import llm
    from tests.test_catalogue import rows

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(llm.oracle_sql()[name]).df(), llm.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_kept_columns_of_clashing_names(spark, docs):
    got = quality_rules.judge(docs, ["doc_id", "n_words"])
    assert got.columns[:3] == ["doc_id", "n_words_input", "n_words"] and {r.n_words_input for r in got.select("n_words_input", "n_words").collect()} == {"x"}
    named = docs.selectExpr("doc_id", "text", "'mine' AS mix_source", "7 AS Mix_Slot", "source", "'s' AS score", "'p' AS ids")
    mixed = mixing.mix(named, ["doc_id", "text"])
    assert {(r.mix_source, r.Mix_Slot_input) for r in mixed.select("mix_source", "Mix_Slot_input").collect()} == {("mine", 7)} and mixed.count() == len(TEXTS)
    assert {r.score_input for r in language_profiles.identify(named, language_profiles.fit(named.where("false").selectExpr("*", "'x' AS lang")), ["score"]).select("score_input", "score").collect()} == {"s"}
    assert {r.score_input for r in toxicity.score(named, None, ["score"]).select("score_input", "score").collect()} == {"s"}
    assert mixing.arranged(named, ["doc_id", "text"]).columns == named.columns
