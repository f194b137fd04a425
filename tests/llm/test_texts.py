"""Packing, chat, html, language, quality, toxicity and decontamination on small inputs."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelspark.llm import chat, decontaminate, html_text, langid, packing, quality, toxicity
from panelspark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"

# Packing --------------------------------------------------------------------------------------


def check_places(lengths, plan, capacity):
    left, used = Counter(lengths), defaultdict(list)
    for length, rank, number, first, offset in plan:
        for k in range(number):
            used[first + k].append((offset, length))
        left[length] -= number
    assert not any(left.values())
    for runs in used.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200))
def test_best_fit_plan(lengths):
    n = check_places(lengths, packing.best_fit_plan(Counter(lengths), 50), 50)
    assert n <= 1.5 * -(-sum(lengths) // 50) + 1


def test_packing_against_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = ["Hello, World! it's 12 naïve—ÉCOLE", None, "", "  \n\t ", "<|endoftext|> in text", "ǅ İstanbul ΣΑΣ é", "don't '90s", "a b 中文 🙂🙂", "word " * 9000]
    texts += [" ".join(rng.choice(["alpha", "Beta,", "x1", "...", "çé", "end.\nNew"]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    rows = list(enumerate(texts))
    rows.append((3, texts[10]))
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 512):
            part = np.array(ids[k : k + 512], "<u4")
            want[(i, k // 512, k, len(part), zlib.crc32(part.tobytes()))] += 1
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), tokenizer_path(), 512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for runs in places.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 512
    assert len(places) <= 1.1 * -(-sum(r.length for r in got) // 512) + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS), tokenizer_path(), 512).count() == 0


# Chat -----------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys[x]", ""]), st.text(alphabet="ab\\<[|/]>s\n", max_size=12)), max_size=6))
def test_chat_round_trip(turns):
    messages = [{"role": r, "text": t} for r, t in turns]
    out, spans, rewrites = chat.render_spans(messages, chat.instruct_template)
    assert chat.read_back(out) == messages and not rewrites
    assert [chat.unescape(out[s:e]) for s, e in spans] == [t for _, t in turns]


def test_templates_that_rewrite_history():
    messages = [{"role": "user", "text": "q"}, {"role": "assistant", "text": "long answer"}, {"role": "user", "text": "r"}]
    last_only = lambda ms: "".join(f"<{m['role']}>{m['text'] if i == len(ms) - 1 or m['role'] != 'assistant' else m['text'][:4]}</t>" for i, m in enumerate(ms))
    assert chat.render_spans(messages, last_only)[2]
    counted = lambda ms: f"{len(ms)}:" + "".join(f"<{m['text']}>" for m in ms)
    out, spans, rewrites = chat.render_spans(messages, counted)
    assert rewrites and [out[s:e] for s, e in spans] == ["q", "long answer", "r"]


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "a<b"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "n"), (3, 0, "assistant", "t"), (3, 0, "assistant", "t")]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {1, 2, 3, None} and got[3].n_turns == 2 and got[3].loss_chars == 2
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\na<b\n").hexdigest() and got[1].loss_sha256 == hashlib.sha256(b"a<b").hexdigest()
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# HTML -----------------------------------------------------------------------------------------


def test_min_cut_against_enumeration():
    rng = random.Random(5)
    for _ in range(40):
        n = rng.randrange(1, 8)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randrange(0, 10))]
        price = lambda lab: sum(-c if not x and c > 0 else 0 for c, x in zip(costs, lab, strict=True)) * -1 + sum(-c for c, x in zip(costs, lab, strict=True) if x and c < 0) + sum(w for u, v, w in edges if lab[u] != lab[v])  # noqa: E731, B023
        best = min(price([k >> i & 1 == 1 for i in range(n)]) for k in range(1 << n))
        assert price(html_text.min_cut(costs, edges)) == pytest.approx(best, abs=1e-6)


def energy(costs, edges, lab):
    return sum(abs(c) for c, x in zip(costs, lab, strict=True) if (c > 0) != x) + sum(w for u, v, w in edges if lab[u] != lab[v])


def test_labels_of_whole_pages_against_enumeration(monkeypatch):
    rng = random.Random(3)
    changed = 0
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            text = " ".join(rng.choice(["word", "and, so", "text."]) for _ in range(rng.choice([1, 2, 12, 40])))
            parts.append(rng.choice(["<p>{}</p>", "<div>{}</div>", "<li>{}</li>", "<div class=ad>{}</div>", "<a href=x>{}</a><hr>", "<h2>{}</h2>", "<article><p>{}</p></article>"]).format(text))
        blocks = html_text.blocks_of("<div>" + "".join(parts) + "</div>")
        seen = []
        monkeypatch.setattr(html_text, "min_cut", lambda costs, edges: seen.append((costs, edges)) or real_min_cut(costs, edges))
        got = html_text.label(blocks)
        costs, edges = seen[0]
        best = min(energy(costs, edges, [k >> i & 1 == 1 for i in range(len(blocks))]) for k in range(1 << len(blocks)))
        assert energy(costs, edges, got) == pytest.approx(best, abs=1e-6)
        changed += sum((c > 0) != x for c, x in zip(costs, got, strict=True))
    assert changed > 5  # smoothness decides some blocks


real_min_cut = html_text.min_cut


def test_cut_finds_content_without_landmarks(spark, small):
    """Tags and class names that tell content are taken out of real pages: the cut then does more than the classifier alone."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    weights = html_text.fit_on(pages)
    alone = cut = n = 0
    for row in pages.collect():
        want = [b.article and not b.chrome for b in html_text.blocks_of(row.html or "")]
        bare = re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer)\b[^>]*>", r"<\1div>", row.html or ""))
        blocks = html_text.blocks_of(bare)
        assert len(blocks) == len(want)
        alone += sum((c > 0) == w for c, w in zip(html_text.content_costs(blocks, weights), want, strict=True))
        cut += sum(x == w for x, w in zip(html_text.label(blocks, weights), want, strict=True))
        n += len(want)
    assert cut > alone and cut > 0.97 * n


def test_deep_and_long_pages_take_linear_time():
    start = time.perf_counter()
    assert html_text.main_text("<article>" + "<div>" * 20_000 + "<p>deep</p>" + "</div>" * 20_000) == "deep"
    assert html_text.main_text("<article>" + "<p>some words, and more.</p></x>" * 5_000).count("\n") == 4_999
    assert time.perf_counter() - start < 30


def test_main_text():
    page = """<html><head><title>T</title><script>if (a<b) document.write("<p>no</p>")</script></head><body><header>Site</header><nav><a href=x>Home</a></nav>
    <main><article><h1>Head &amp; line</h1><p>One  two&nbsp;three<br>four <b>bold</b>.<p>Second &lt;para&gt;<ul><li>item <a href=y>link</a></li></ul><div class="share-buttons">Tweet</div>
    <aside>Aside</aside><form><p>Sign up</p></form><section id="comments"><p>I am a reader.</p></section></article></main><div class="cookie-notice">We use cookies.</div><footer>&copy; 2024</footer>"""
    assert html_text.main_text(page).split("\n") == ["Head & line", "One two three four bold.", "Second <para>", "item link"]
    soup = "<div><div class=menu><a>a</a> <a>b</a></div><div><p>A paragraph that goes on for a while, with commas, and with more than one sentence. So it is text.</p><p>Short.</p><p>Another long paragraph of running text, again with commas, and an end.</p></div><div><a href=1>About</a> <a href=2>Contact us</a></div></div>"
    assert html_text.main_text(soup).split("\n")[1] == "Short." and "Contact" not in html_text.main_text(soup)
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("<!-- never closed <p>x") == "" and "deep" in html_text.main_text("<article>" + "<div>" * 3000 + "<p>deep</p>")


def test_extract_main_text(spark):
    rows = [(1, "u", "<article><p>é</p></article>"), (1, "u", "<article><p>é</p></article>"), (None, None, None)]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "é", 1), (1, "é", 1)]
    assert html_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clash = spark.createDataFrame([(1, "u", "<article><p>é</p></article>", "t", 5)], "page_id long, url string, html string, text string, n_chars long")
    assert [tuple(r) for r in html_text.extract_main_text(clash).collect()] == [(1, "u", "é", 1)]


# Language, quality, toxicity ----------------------------------------------------------------------


def learned(spark):
    rng = random.Random(4)
    en, de = "the of and to in is that with".split(), "der die und zu den ist das mit".split()
    rows = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(rng.randrange(3, 60))), "en" if i % 2 else "de") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 150)
    docs = learned(spark)
    sample = docs.where("doc_id < 200").collect()
    model = langid.train([r.text.encode() for r in sample], [r.lang for r in sample], steps=150)
    assert not any(map(langid.has_letter, [None, "", "12 ²½Ⅷ _"])) and langid.has_letter("12 é")
    odd = spark.createDataFrame([(1000, None, None), (1001, "123 !! ²½", None), (1002, "", None), (1003, "the of and " * 9000, "en")], docs.schema)
    got = {r.doc_id: r for r in langid.predict_languages(docs.where("doc_id >= 200").unionByName(odd), model).collect()}
    assert sum(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(200, 300)) >= 95
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und"] * 3 + ["en"] and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict_languages(docs.limit(0), model).count() == 0 and langid.train_on(docs.limit(0)) is None
    kept = langid.keep_known_languages(docs.unionByName(odd), model, 0.3)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(300)) | {1003}


def test_windows_cover_whole_texts():
    model = langid.train([b"the of and"] * 4 + [b"der die und"] * 4, ["en"] * 4 + ["de"] * 4, steps=80)
    whole = langid.Predictor(model)
    text = "the of and " * 100 + "der die und " * 600
    assert whole.predict([text])[0] == ["de"]
    x = np.zeros((3, langid.WINDOW), np.uint8)
    x[:, :40] = np.random.default_rng(0).integers(1, 255, (3, 40))
    plain = langid.softmax(np.maximum(model.responses(x)[0] + model.bias, 0) @ model.weights + model.out_bias)
    assert np.allclose(plain, model.probabilities(x, model.pair_tables()), atol=1e-5)


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice("plain words stand in rows here".split()) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice("BUY!! NOW!! ### %%%".split()) for _ in range(40))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 200)], "doc_id long, quality int")
    net = quality.train_on(docs.where("doc_id < 200"), labels)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "x" * 100_000), (None, "plain words")], DOCS)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs.where("doc_id >= 200").unionByName(odd), net).collect()}
    assert all((got[i] >= 0.3) == (i % 5 != 0) for i in range(200, 400)) and all(0 <= s <= 1 for s in got.values())
    twice = docs.limit(3).unionByName(docs.limit(3)).withColumn("score", F.lit("x"))
    assert quality.quality_scores(twice, net).count() == 6
    assert quality.train_on(docs.limit(0), labels) is None and quality.quality_scores(docs.limit(0), net).count() == 0


def rewritings(machine, symbols):
    """Every output of an accepting path, by trying all arcs."""
    found = []

    def go(k, state, out):
        if k == len(symbols):
            if state in machine.finals:
                found.append(out)
            return
        for y, w, nxt in machine.arcs[state].get(symbols[k][0], []):
            go(k + 1, nxt, [*out, (y, symbols[k][1] * w)])

    for start in machine.starts:
        go(0, start, [])
    return found


def test_composed_grammar_against_paths_of_its_parts():
    rng = random.Random(12)
    weights = {k: rng.uniform(0.1, 1) for k in toxicity.PRIOR}
    g = toxicity.Grammar({}, {}, weights=weights)
    parts = toxicity.grammar_parts(weights)
    for _ in range(300):
        symbols = [(rng.choice(list(toxicity.WORDS)), 1.0) for _ in range(rng.randrange(0, 9))] + [(toxicity.BREAK, 1.0)]
        outs = [symbols]
        for part in parts:
            outs = [o for before in outs for o in rewritings(part, before)]
        assert len(outs) == 1  # the grammar is unambiguous
        want, clause = [], []
        for y, w in outs[0]:
            if y in (toxicity.END, toxicity.BREAK):
                want, clause = [*want, clause] if clause else want, []
            elif y % toxicity.FLAG in (toxicity.MATCH_INSULT, toxicity.MATCH_THREAT):
                clause = [*clause, (y, w)]
        got = toxicity.clause_matches(g.machine, symbols)
        assert [[m for m, _ in c] for c in got] == [[m for m, _ in c] for c in want]
        assert np.allclose([w for c in got for _, w in c], [w for c in want for _, w in c])


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idiot": 0.95}, {"moro": 0.95})
    score = lambda t: toxicity.text_score(t, g)
    assert score("you idiot") >= 0.7 and score("such morons you are") >= 0.7 and score("a fine day") == pytest.approx(0.05)
    assert score("an idiot on it") < 0.7  # alone, and no label says more
    assert score("he said you are not an idiot") < score("you are an idiot")
    assert score('someone wrote "idiot" on it') < score("an idiot on it") < score("an idiot on it, you know")
    assert score("I will kill you") >= 0.7 and score("kill time") == pytest.approx(0.05)
    assert score("I will not kill you") < 0.7
    assert score(None) == score("") == pytest.approx(0.05)
    flags = [[(m % toxicity.FLAG, m // toxicity.FLAG) for m, _ in c] for c in g.matches("never idiot. you idiot\nhe said an idiot")]
    assert flags == [[(toxicity.MATCH_INSULT, toxicity.NEGATED)], [(toxicity.MATCH_INSULT, toxicity.AIMED)], [(toxicity.MATCH_INSULT, toxicity.REPORTED | toxicity.AIMED)]]


def test_labels_teach_the_grammar_its_contexts(spark):
    """The same insults, denied or quoted in clean texts: with all patterns alike, as isolated words count, decisions differ."""
    rng = random.Random(14)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(5) for b in range(8)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    holds = lambda i: f" {say(1)} zork {say(4)}" if i % 2 else f". never zork {say(4)}." if i % 16 == 0 else ""
    rows = [(i, say(12) + holds(i) + "\n" + say(9)) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    g = toxicity.learn_grammar(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    words_only = toxicity.Grammar(g.words, g.stems, weights={k: 1.0 for k in toxicity.PRIOR})
    wrong = lambda m: sum((toxicity.text_score(t, m) >= 0.7) != (i % 2 == 1) for i, t in rows[200:])
    assert wrong(g) == 0 and wrong(words_only) == 6


def test_toxicity_learns_terms(spark):
    rng = random.Random(8)
    words = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" zork" + rng.choice("abc") if i % 4 == 0 else "")) for i in range(240)]
    docs = spark.createDataFrame([*rows, (500, None)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    g = toxicity.learn_grammar(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, g).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in range(160, 240)) and got[500] < 0.7
    assert toxicity.learn_grammar(docs.limit(0), labels.limit(0)).words == {}
    twice = docs.limit(3).unionByName(docs.limit(3)).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    assert toxicity.toxicity_scores(twice, g).count() == 6
    plain = {i: toxicity.text_score(t, g) for i, t in rows}
    assert all(abs(plain[i] - got[i]) < 1e-12 for i in plain)


def test_pu_risk_and_prior():
    """The gradient of training against differences of the risk, on both sides of zero, and the prior of mixtures."""
    rng = np.random.default_rng(1)
    xp, xu = rng.normal(size=(40, 6)), rng.normal(size=(40, 6))
    below = 0
    for bias in (0.5, 6.0):
        parameters = [rng.normal(0, 0.5, (6, 5)), rng.normal(0, 0.5, 5), rng.normal(0, 0.5, 5), np.array([bias])]
        for prior, unlabelled in ((0.4, xu), (0.99, xu - 3.0 * np.sign(parameters[0] @ parameters[2]))):
            g = lambda x: np.tanh(x @ parameters[0] + parameters[1]) @ parameters[2] + parameters[3][0]  # noqa: B023, E731
            negative = np.log1p(np.exp(g(unlabelled))).mean() - prior * np.log1p(np.exp(g(xp))).mean()
            objective, gradient = quality.risk_gradient(parameters, xp, unlabelled, prior)
            want = -negative if negative < 0 else prior * np.log1p(np.exp(-g(xp))).mean() + negative
            assert abs(objective - want) < 1e-12
            below += negative < 0
            for p, gr in zip(parameters, gradient, strict=True):
                for at in list(np.ndindex(p.shape))[:7]:
                    step, held = 1e-5, p[at]
                    values = []
                    for sign in (1, -1):
                        p[at] = held + sign * step
                        values.append(quality.risk_gradient(parameters, xp, unlabelled, prior)[0])
                    p[at] = held
                    assert abs((values[0] - values[1]) / (2 * step) - gr[at]) < 1e-7
    assert 0 < below < 4
    for prior in (0.3, 0.7):
        good, other = rng.normal(1.5, 1, (900, 6)), rng.normal(-1.5, 1, (900, 6))
        mixed = np.concatenate([rng.normal(1.5, 1, (int(1200 * prior), 6)), other[: int(1200 * (1 - prior))]])[rng.permutation(1200)]
        found = quality.estimate_prior(good, mixed)
        assert abs(found - prior) < 0.1
        net = quality.train_pu(good, mixed, found, steps=300)
        assert (net.score(good) >= 0.5).mean() > 0.95 and (net.score(other) < 0.5).mean() > 0.95


# Decontamination -----------------------------------------------------------------------------------


def test_lcs():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(9)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 40))], [rng.randrange(6) for _ in range(rng.randrange(0, 60))]
        masks = {}
        for k, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << k
        assert decontaminate.lcs(masks, len(a), b) == slow(a, b)


def test_contaminated(spark):
    rng = random.Random(10)
    vocabulary = [f"{a}{b}" for a in "ba ce di fo gu".split() for b in "lor mit nas pet rix sun tav wez".split()] + ["the", "of"] * 10
    say = lambda n: [rng.choice(vocabulary) + rng.choice(["", "en", "ur", "a"]) for _ in range(n)]
    items = [(i, " ".join(say(18 + 2 * i)) + ". " + " ".join(say(6)) + ".") for i in range(12)] + [(50, None), (51, "")]
    rows, want = [], set()
    for d in range(150):
        text = say(rng.randrange(5, 200))
        if d % 10 == 0:
            item = items[(d // 10) % 12]
            its = item[1].split()
            if d % 20 == 0:  # light paraphrase
                for k in range(2, len(its), 7):
                    its[k] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = its
            want.add((d, item[0]))
        elif d % 10 == 1:  # shares a phrase only
            text[2:2] = items[d % 12][1].split()[:6]
        rows.append((d, " ".join(text)))
    rows += [(900, None), (901, ""), (rows[0][0], rows[0][1])]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()]
    assert set(got) == want and len(got) == len(want) + 1
    left = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    # against a search of every passage with every item, without cosines
    counts = Counter(w for _, t in rows for w in decontaminate.words_of(t))
    passages = sum(len(decontaminate.words_of(t)) // decontaminate.PASSAGE + 1 for _, t in rows)
    weight = {w: max(0.1, np.log((passages + 1) / (counts[w] + 0.5))) for _, t in items for w in decontaminate.words_of(t)}
    plain = set()
    for d, t in rows:
        ws = decontaminate.words_of(t)
        for i, it in items:
            its = decontaminate.words_of(it)
            if not its or not ws:
                continue
            masks = {}
            for k, w in enumerate(its):
                masks[w] = masks.get(w, 0) | 1 << k
            answer = set(decontaminate.words_of([x for x in re.split("[.!?]+", it) if x.strip()][-1]))
            for at in decontaminate.starts_of(len(ws)):
                near = ws[max(0, at - len(its)) : at + decontaminate.PASSAGE + len(its)]
                there = set(near)
                covered = sum(weight[w] for w in set(its) & there) / sum(weight[w] for w in set(its))
                if decontaminate.lcs(masks, len(its), near) >= decontaminate.LEAST_LCS * len(its) and len(answer & there) >= decontaminate.LEAST_ANSWER * len(answer) and covered >= decontaminate.LEAST_WEIGHT:
                    plain.add((d, i))
    assert plain == want
    clash = docs.selectExpr("doc_id", "text", "doc_id AS item_id", "text AS start")
    assert decontaminate.contaminated(clash, bench).count() == len(got) and decontaminate.drop_contaminated(clash, bench).columns == clash.columns
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_one_space_whatever_the_blocks(spark, small, monkeypatch):
    """All items share one space of fewer axes than passages; blocks of three items find the same with the same cosines."""
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    show = lambda: sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    whole = show()
    items = decontaminate.Block.of([(r.item_id, r.text) for r in bench.collect() if r.text]).items
    ids = decontaminate.encoded(docs, {w: decontaminate.number_of(w) for r in bench.collect() for w in decontaminate.words_of(r.text)})
    space = decontaminate.latent_space(ids, items)
    passages = decontaminate.Block(items).passages()[1]
    assert space.axes.shape[1] == decontaminate.RANK <= len(passages) / 2
    held = space.axes[np.unique(np.concatenate(passages))]
    assert np.allclose(held.T @ held, np.eye(decontaminate.RANK), atol=1e-3)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    assert whole and show() == whole


def test_axes_are_fitted_on_all_documents(spark):
    """Twelve words that stand together only in documents of the highest third of hashes span one of the axes."""
    rng = np.random.default_rng(4)
    rows = spark.range(30_000).selectExpr("id AS doc_id", "xxhash64(id) > 3074457345618258602 AS late").collect()
    late = np.arange(100, 112)
    of = lambda r: late if r.late else rng.choice(60, 3, replace=False)
    ids = spark.createDataFrame([(r.doc_id, bytearray(of(r).astype(np.uint16).tobytes())) for r in rows], "doc_id long, ids binary")
    items = [(k, np.r_[rng.permutation(60)[:20], late[k % 12 : k % 12 + (k < 12)]], {0}) for k in range(36)]
    axes = decontaminate.latent_space(ids, items).axes
    assert axes.shape[1] < 60 and np.linalg.norm(axes[late].sum(axis=0) / np.sqrt(12)) > 0.99


def test_pipeline_fits_axes_on_every_document(spark, small, monkeypatch):
    """Both products of the decontamination stage read all 21,000 documents, and so does the search."""
    import corpus_pipeline

    counts, product = [], decontaminate.times_gram
    monkeypatch.setattr(decontaminate, "times_gram", lambda ids, *rest: counts.append(ids.count()) or product(ids, *rest))
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first().text
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3000 == 7, F.lit(item)).otherwise(F.concat_ws(" ", F.lit("one of"), "id")).alias("text"))
    left = corpus_pipeline.benchmark_leaks(spark, docs, small)
    assert counts == [21_000, 21_000] and left.count() == 20_993


def test_turn_spans_from_consecutive_outputs():
    messages = [{"role": r, "text": t} for r, t in (("user", "aba"), ("assistant", "b"), ("user", ""), ("assistant", "</t>b</t>"))]
    trailed = lambda ms: "<s>" + "".join(f"<t>{m['role'][0]}:{m['text']}</t>" for m in ms) + "</s>"
    out, turns, texts, rewrites = chat.render_turns(messages, trailed)
    assert not rewrites and [out[s:e] for s, e in texts] == [m["text"] for m in messages]
    # a trailer that begins like a turn may move a span by what both share; its length and the whole stay right
    assert [e - s for s, e in turns] == [len(f"<t>u:{m['text']}</t>") for m in messages]
    out, turns, texts, rewrites = chat.render_turns(messages, chat.instruct_template)
    assert not rewrites and "".join(out[s:e] for s, e in turns) == out[3:]
    assert [out[s:e] for s, e in turns] == [chat.instruct_template([m])[3:] for m in messages]
    for rewriting in (lambda ms: f"{len(ms)} turns: " + trailed(ms), lambda ms: trailed(ms[-2:]), lambda ms: trailed(ms[::-1])):
        assert chat.render_turns(messages, rewriting)[3]
    out, turns, texts, rewrites = chat.render_turns(messages, lambda ms: trailed(ms[::-1]))
    assert [out[s:e] for s, e in texts] == [m["text"] for m in messages]


def test_chat_of_clashing_columns_and_long_conversations(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} [x] </turn>") for i in range(300)] + [(None, 0, None, None), (None, 0, None, None), (2, 5, "assistant", "z" * 100_000), (3, 1, "user", "one"), (3, 1, "user", "one")]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clashing = plain.selectExpr("*", "'x' AS formatted", "'y' AS n_turns", "turn AS loss_spans", "role AS conv")
    show = lambda df: {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    got = show(clashing)
    assert got == show(plain) and {c: r.n_turns for c, r in got.items()} == {1: 300, None: 2, 2: 1, 3: 2}
    said = "".join(t for c, _, r, t in rows if c == 1 and r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert (got[None].loss_chars, got[2].loss_chars) == (0, 100_000)



def _templates():
    """Made here, so that they travel to the workers by value."""
    turn = lambda m: f"<t>{m['role'][:1]}:{m['text']}</t>"

    def refusing(ms):
        if ms and ms[0]["role"] == "assistant":
            raise ValueError("begins with an answer")
        return "".join(map(turn, ms))

    return {
        "appending": chat.instruct_template,
        "trailer like a turn": lambda ms: "<s>" + "".join(map(turn, ms)) + "<t>assistant:",
        "head from the first turn": lambda ms: f"<{ms[0]['text'] if ms else ''}>" + "".join(map(turn, ms[1:])),
        "numbers turns": lambda ms: "".join(f"{k}{turn(m)}" for k, m in enumerate(ms)),
        "counts in front": lambda ms: f"{len(ms)}" + "".join(map(turn, ms)),
        "refuses": refusing,
    }


@pytest.mark.parametrize("name", list(_templates()))
def test_parts_of_long_conversations_equal_whole_renderings(spark, name):
    template = _templates()[name]
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} [x] </t>") for i in range(230)] + [(2, i, "user", "u" * i) for i in range(19)]
    rows += [(None, None, None, None)] * 45 + [(None, 3, "assistant", "ä" * 300)] * 3 + [(c, 0, "user", f"only {c}") for c in range(3, 20)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got: dict = {}
    parts = chat.format_parts(chats, template, block=16, context=3).collect()
    for r in sorted(parts, key=lambda r: r.place):
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == {r[0] for r in rows}
    if name in ("appending", "trailer like a turn"):
        assert len(got[1]) >= 14 and len(got[None]) >= 3 and max(r.n_turns for r in parts) <= 16
    for conv, some in got.items():
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        messages = [{"role": r or "", "text": t or ""} for _, _, r, t in mine]
        whole, turns, texts, rewrites = chat.render_turns(messages, template)
        assert "".join(r.formatted for r in some) == whole and {r.rewrites_history for r in some} == {rewrites}
        starts = [sum(len(r.formatted) for r in some[:k]) for k in range(len(some))]
        moved = lambda field: [(s.start + at, s.end + at) for r, at in zip(some, starts, strict=True) for s in r[field]]  # noqa: B023, E731
        assert moved("turn_spans") == turns
        assert moved("loss_spans") == [span for m, span in zip(messages, texts, strict=True) if m["role"] == "assistant"]


def test_numbered_turns_keep_the_order(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, 0, 1) for r in ("a" * 70, "a" * 63, "b") for x in ("y" * 255, "y" * 256, "y" * 257, "y" * 256 + "a", "")] * 3
    got = chat.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("place").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])
    assert [r.place for r in got] == list(range(len(rows)))
    assert [(r.conv_id, r.role, r.text) for r in got] == [(c, r, x) for c, _, r, x in sorted(rows, key=key)]


def test_only_tokenizers_that_work_by_chunks_are_taken_apart():
    from tokenizers import Tokenizer, normalizers

    folder = tokenizer_path().rsplit("/", 1)[0]
    texts = ["Hello, World.\n It's 12 o'clock...  OK", "", " ", "Ünïcödé <|endoftext|> x", "a.b , c\t\td"]
    for name, by_chunks in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        encoder, plain = packing.ChunkTokenizer(f"{folder}/{name}"), Tokenizer.from_file(f"{folder}/{name}")
        assert encoder.by_chunks == by_chunks
        assert [encoder.encode(t).tolist() for t in texts] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    plain = Tokenizer.from_file(f"{folder}/word_bpe_49k.json")
    assert packing.works_by_chunks(plain)
    plain.normalizer = normalizers.NFC()
    assert not packing.works_by_chunks(plain)
