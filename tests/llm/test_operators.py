"""Each operator against brute force on small tables, and its defined results on odd ones."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspan.functions.hosts import plain_host
from quillspan.llm import codepoints, leakage, near_duplicates, rank_aggregation, repeated_lines, residue, shared_spans, spam, term_bitmaps, tokenizer
from tests.conftest import rows

VOCABULARY = [f"w{i}" for i in range(300)]
ODD = [(900, None), (901, ""), (902, "  \n\t "), (903, "x"), (904, "😀" * 50), (905, "Ünïcode 日本語 texts")]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def words(text):
    out, now = [], ""
    for c in text or "":
        if c.isalnum():
            now += c.lower()
        elif now:
            out.append(now)
            now = ""
    return out + [now] * bool(now)


def frame(spark, data, schema="id bigint, text string"):
    """With an extra column whose name the operators use inside."""
    return spark.createDataFrame(data, schema).withColumn("fp", F.lit("clash")).withColumn("rep", F.lit(1))


# --- 1 ---


def near_texts(seed=1):
    r = random.Random(seed)
    data = []
    for i in range(25):
        base = prose(r, 100)
        data.append((i * 10, base))
        for k in range(r.choice([0, 1, 3])):
            ws = base.split()
            for _ in range(r.randint(1, 12)):
                ws[r.randrange(len(ws))] = r.choice(VOCABULARY)
            data.append((i * 10 + 1 + k, " ".join(ws)))
    data += [(500 + i, data[0][1].upper()) for i in range(30)]  # a third are copies
    return data + ODD + [data[3], data[3]]


def shingled(text, k=3):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_pairs(data, least=0.7, k=3, n=80):
    sets = {i: shingled(t, k) for i, t in data if t and len(words(t)) >= n}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_near_duplicate_pairs_equal_brute_force(spark):
    data = near_texts()
    s = near_duplicates.Settings(shingle=3, similarity=0.7, min_words=80, block=4)
    op = near_duplicates.NearDuplicates(frame(spark, data), "id", "text", s)
    assert set(rows(op.pairs())) == brute_pairs(data)


def test_near_duplicate_classes_are_the_components(spark):
    data = near_texts(2)
    pairs = brute_pairs(data)
    s = near_duplicates.Settings(shingle=3, similarity=0.7, min_words=80)
    got = {r.id: r.class_id for r in near_duplicates.NearDuplicates(frame(spark, data), "id", "text", s).classes().collect()}
    parent = {i: i for i in got}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert {i: find(i) for i in got} == got


def test_components_of_long_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    hub = [(100, i) for i in range(101, 160)]
    got = dict(rows(near_duplicates.components(spark.createDataFrame(chain + hub + [(5, 5)], "a bigint, b bigint"))))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_candidate_pairs_of_a_crowded_key_are_complete(spark):
    keyed = spark.createDataFrame([(7, i) for i in range(50)], "key bigint, id bigint")
    assert near_duplicates.candidate_pairs(keyed, 8).count() == 50 * 49 // 2


def test_near_duplicates_of_nothing(spark):
    op = near_duplicates.NearDuplicates(frame(spark, []), "id", "text")
    assert rows(op.pairs()) == [] and rows(op.classes()) == []


# --- 2 and 4 ---


@pytest.fixture(scope="module")
def model():
    r = random.Random(3)
    nouns = "letter garden workshop drawing river postcard lantern bench kettle orchard storm notebook".split()
    verbs = "needed the|was worth more than the|stood beside the|can still be seen from the|ran past the|belonged to the".split("|")
    adverbs = "Last December|This time|At first|Strictly speaking|For years|In April|To my surprise".split("|")
    line = lambda: f"{r.choice(adverbs)} the {r.choice(nouns)} {r.choice(verbs)} {r.choice(nouns)} until somebody had repaired the {r.choice(nouns)}."
    natural = [" ".join(line() for _ in range(12)) for _ in range(400)]
    return residue.fit(natural[:300]), natural


def test_residue_finds_held_out_cases_and_spares_prose(model):
    m, natural = model
    cases = [
        "Please switch on JavaScript in your browser to view the catalogue of Oldanri.",
        "Error 404: the page you requested could not be found on this server. Try again later.",
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
        "foo bar asdf qwer test test jkl bla bla asdf foo test xyz asdf bla test jkl foo bar",
        natural[301] + " Contact {{ company }} for more.",
        natural[302] + " The price is %PRICE% a month.",
        natural[303] + " " + " ".join("lorem ipsum dolor sit amet consectetur elit sed tempor magna aliqua veniam nostrud".split() * 2),
        "PAGE NOT FOUND. THE REQUESTED URL WAS NOT FOUND ON THIS SERVER.",
    ]
    assert [t for t in cases if not residue.is_residue(m, t)] == []
    spared = natural[310:400] + [
        None,
        "",
        " \n ",
        natural[304] + " In a template one writes `{{ name }}` and the engine fills it. " + natural[305],
        natural[306] + " A shell script expands ${HOME} first. Let the set be {1, 2, 3} and 40% of it odd [sic]. " + natural[307],
        natural[308] + ' The phrase "Please enable JavaScript" made me close the page. ' + natural[309],
        natural[304] + " Printers set lorem ipsum because nobody reads it. When the server answered 500 Internal Server Error, I looked at the log. " + natural[305],
    ]
    assert [t for t in spared if residue.is_residue(m, t)] == []


@pytest.mark.parametrize("text", ["{{x}}", "{% block a %}", "<%= name %>", "${title}", "%TITLE%", "[[first line]]", "[Your name]", "[city here]", "xxx date xxx", "TODO: add body", "INSERT NAME HERE", "__AUTHOR__", "@@city@@", "#CITY#", "<user-name>", "for {0} days"])
def test_placeholders(text):
    assert residue.placeholder(f"The garden {text} of the house.") and not residue.placeholder(f"Write `{text}` there.")


@pytest.mark.parametrize("text", ["{firstname}", "{FIRST_NAME}", "{{#if user}}", "{{ user.name | upper }}", "<?= $name ?>", "*|FNAME|*", "<nickname>", "[Company Name]", "$name$", "((name))", "{# name #}", "{first_name}", "%first_name%", "[% name %]", "{$name}", "{{{raw}}}"])
def test_placeholders_of_common_engines(text):
    assert residue.placeholder(f"The garden {text} of the house.") and not residue.placeholder(f"Write `{text}` there.")


@pytest.mark.parametrize("text", ["[sic]", "{1, 2, 3}", "${HOME}", "<b>", "$5 and $6", "[1]", "100% of 5%", "((see note))", "[Editor's note]", "#garden #tools", "[Paris]", "a $4 b$ c", "{a, b}", "[The letter ends]", "<time>"])
def test_signs_of_prose_are_no_placeholders(text):
    assert not residue.placeholder(f"The garden {text} of the house.")


def test_residue_pages_over_repeated_lines(spark, model):
    _, natural = model
    line = "Please consider a gift to the fund of this old site"
    data = [(i, "a.test", f"{line}\n{natural[i]}") for i in range(30)] + [(50, "A.test", f"{line}\nYou need to enable JavaScript to run this app."), (51, "a.test", None), (52, "a.test", line), (50, "A.test", f"{line}\nYou need to enable JavaScript to run this app.")]
    df = spark.createDataFrame(data, "id bigint, host string, text string")
    assert rows(residue.residue_pages(df, "id", plain_host(F.col("host")), "text")) == [(50,)]


def test_residue_in_short_lines_between_repeated_ones(spark, model):
    _, natural = model
    line = "Last December the old site of the garden club was worth more than the drawing that stood beside the river until somebody had repaired it"
    data = [(i, "a.test", f"{line}\n{natural[i]}") for i in range(20)] + [(50, "a.test", "\n".join(f"{x}\n{line}" for x in ("Loading", "504", "Gateway", "Time-out", "nginx")))]
    df = spark.createDataFrame(data, "id bigint, host string, text string")
    assert rows(residue.residue_pages(df, "id", F.col("host"), "text")) == [(50,)]


def test_sample_holds_whole_texts(spark):
    texts = ["word " * 2000, "short"]
    assert residue.natural_sample(frame(spark, list(enumerate(texts))), "id", "text") == texts[:1]


def test_residue_models_know_every_text_and_not_long_ones_only(spark):
    r = random.Random(8)
    what = "browser|server|page|script|address|cookie|error".split("|")
    line = lambda: f"The reader of this {r.choice(what)} could enable the {r.choice(what)} and reload the {r.choice(what)} in your {r.choice(what)} to continue."
    data = [(i, f"h{i}.test", " ".join(line() for _ in range(4))) for i in range(300)]
    assert max(len(t) for *_, t in data) < residue.LEAST_CHARS
    data.append((900, "a.test", "504 Gateway Time-out. nginx"))
    df = spark.createDataFrame(data, "id bigint, host string, text string")
    assert rows(residue.residue_pages(df, "id", F.col("host"), "text")) == [(900,)]


def test_residue_models_of_spread_texts_are_those_of_all(spark, model):
    _, natural = model
    r = random.Random(9)
    texts = [f"{t} {''.join(r.choices('abcdefghij', k=7))}" for t in natural] + ["", "x", "😀" * 50, "Ünïcode 日本語 texts"] + ["Error 404: the page could not be found on this server."] * 9
    data = list(enumerate(texts))
    whole = residue.fit(texts)
    for parts in (1, 7):
        got = residue.fit_corpus(spark.createDataFrame(data, "id bigint, text string").repartition(parts))
        for kind, by_order in whole.ratios.items():
            assert all((got.ratios[kind][n].tobytes() == ratio.tobytes()) for n, ratio in by_order.items())


def test_spam_items_parted_by_repeated_lines(spark):
    r = random.Random(4)
    names = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(200)]
    line = "This is the shop of the old town and we are glad that you have come to see what is in it for you"
    data = [(i, "a.test", f"{line}\n" + "The lamp of the house was older than the road, and nobody could say who had made it for us. " * 3) for i in range(20)]
    data.append((50, "a.test", "\n".join(f"{r.choice(names)} sale {r.choice(names)}\n{line}" for _ in range(40))))
    df = spark.createDataFrame(data, "id bigint, host string, text string")
    assert rows(spam.spam_pages(df, "id", F.col("host"), "text")) == [(50,)]


def test_residue_and_spam_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, host string, text string")
    assert rows(residue.residue_pages(df, "id", F.col("host"), "text")) == [] and rows(spam.spam_pages(df, "id", F.col("host"), "text")) == []


def test_spam_kinds():
    r = random.Random(4)
    names = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(200)]
    shop = "buy cheap best price sale online store discount review order".split()
    repeated = " ".join(r.choice(["zomir lamp", r.choice(shop)]) for _ in range(80))
    links = "\n".join(f"{r.choice(names)} {r.choice(shop)} {r.choice(names)}" for _ in range(40))
    tags = " ".join("#" + r.choice(names + ["blue", "red", "xl"]) for _ in range(60))
    places = ", ".join(f"zomir lamp in {r.choice(names)}" for _ in range(30))
    assert [spam.is_spam(t) for t in (repeated, links, tags, places)] == [True] * 4
    glossary = "\n".join(f"{n}: a word for the tool that we use when the {m} of the loom is worn" for n, m in zip(names[:20], names[20:40]))
    refrain = "\n".join(["And the river ran on to the sea in the night", f"We went with the {names[1]} to see what was there"] * 12)
    prose_ = "The lamp of the house was older than the road, and nobody could say who had made it for us. " * 8
    assert [spam.is_spam(t) for t in (glossary, refrain, prose_, None, "", "buy buy buy")] == [False] * 6


def spam_shapes():
    r = random.Random(4)
    names = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(300)]
    one = lambda: r.choice(names)
    cycle = "lamp vase shade bulb desk chair sofa table mirror carpet curtain shelf stool bench".split()
    return {
        "a cycle of 14 keywords": " ".join(cycle * 6),
        "a cycle of 40 keywords": " ".join((cycle + names[:26]) * 4),
        "29 nouns": ", ".join(r.sample(names, 29)),
        "30 nouns without separators": " ".join(r.sample(names, 30)),
        "24 words": " ".join("cheap lamps buy".split() * 8),
        "words and numbers": " ".join(f"{one()} {r.randint(1, 900)}" for _ in range(30)),
        "a frame with function words": ". ".join(f"cheap {one()} for sale in {one()} and {one()} near you" for _ in range(12)),
        "price list": "\n".join(f"{one()} {one()} {r.randint(1, 900)}.{r.randint(10, 99)} EUR add to basket {one()} {one()} in stock" for _ in range(25)),
        "places": " | ".join(f"{one()} in {one()}" for _ in range(20)),
    }


@pytest.mark.parametrize("kind", list(spam_shapes()))
def test_spam_shapes(kind):
    assert spam.is_spam(spam_shapes()[kind])


def test_link_titles_with_function_words_need_their_links():
    r = random.Random(5)
    names = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(60)]
    titles = [f"The best of {n}" for n in names[:8]] + [f"How to buy a {n} for your {m}" for n, m in zip(names[8:16], names[16:24])] + [f"Where the {n} was made" for n in names[24:32]]
    r.shuffle(titles)
    assert spam.is_spam("\n".join(titles), titles, 0.9) and not spam.is_spam("\n".join(titles))


def test_what_only_looks_like_spam():
    r = random.Random(6)
    names = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(60)]
    annotated = "\n".join(f"{n} - which {r.choice(['my father made for the', 'nobody had seen since the', 'we found under an old'])} {m} in {r.choice(['spring', 'May'])}" for n, m in zip(names[:20], names[20:40]))
    frames = ["Para la {} hace falta una {} vieja y 40 gramos de sal", "Dicen que la {} es más vieja que la {} donde duerme el perro", "La {} junto a la {} aún no estaba hallada", "En el cuaderno, la {} aparece vendida con la {} de mi padre"]
    spanish = ". ".join(r.choice(frames).format(r.choice(names), r.choice(names)) for _ in range(14))
    trace = "Sorry, this did not work\n" + "\n".join(f"  at {r.choice(names)}.{r.choice(names)} ({r.choice(names)}.js:{i * 31}:{i})" for i in range(1, 12))
    unfilled = "\n".join(f"Price {{{{{n}}}}}" for n in names[:12])
    said_again = "And the river ran on to the sea in the night.\n" * 14
    assert [spam.is_spam(t) for t in (annotated, spanish, trace, unfilled, said_again, "Home\nNext page")] == [False] * 6


def test_spam_judges_texts_alike_alone_and_together():
    texts = [*spam_shapes().values(), None, "", "x", "The lamp of the house was older than the road, and nobody could say who had made it for us. " * 8]
    arr = spam.pa.array(texts, spam.pa.string())
    assert list(spam.judged(arr)) == [bool(spam.judged(spam.pa.array([t], spam.pa.string()))[0]) for t in texts]


def test_spam_of_a_hot_source_with_odd_rows(spark):
    """Half of the rows under one source, one keyword in all of them; null links and null density; a repeated id."""
    text = spam_shapes()["price list"]
    plain = "The lamp of the house was older than the road, and nobody could say who had made it for us."
    data = [(i, "hot", text, None, None) for i in range(4)] + [(i, f"h{i}", plain, [None, plain], 0.9) for i in range(10, 20)] + [(1, "hot", text, None, None), (None, "hot", text, [], 0.0), (30, None, None, [], None)]
    df = spark.createDataFrame(data, "id bigint, host string, text string, links array<string>, density double")
    assert sorted(rows(spam.spam_pages(df, "id", F.col("host"), "text", F.col("links"), F.col("density")))) == [(i,) for i in range(4)]


# --- 3 ---


def test_ranks_and_order_equal_brute_force(spark):
    r = random.Random(5)
    value = lambda: r.choice([None, float("nan"), 0.0, 0.0, -3.5, r.random() * 10 ** r.randint(-3, 6)])
    data = [(q, d, value(), value()) for q in (1, 2) for d in range(60)]
    data += data[:5] + [(None, 1, 1.0, 1.0), (1, None, 1.0, 1.0), (3, 1, None, None)]
    ranked = rank_aggregation.score_ranks(spark.createDataFrame(data, "q bigint, d bigint, a double, b double"), "q", "d", ["a", "b"])
    got = {(x.q, x.d): (x.greater_a, x.greater_b, x.rank_a, x.rank_b, x.n) for x in ranked.collect()}
    once = {(q, d): tuple(None if v is None or v != v else v for v in (a, b)) for q, d, a, b in data if q is not None and d is not None}
    want = {}
    for (q, d), vs in once.items():
        own = [v for (x, _), v in once.items() if x == q]
        greater = [None if v is None else sum(o[i] is not None and o[i] > v for o in own) for i, v in enumerate(vs)]
        rank = [1 + (g if g is not None else sum(o[i] is not None for o in own)) for i, g in enumerate(greater)]
        want[q, d] = (*greater, *rank, len(own))
    assert got == want
    placed = rank_aggregation.aggregate_ranks(ranked, "q", "d", ["a", "b"], {"a": F.lit(2.0), "b": F.lit(1.0)})
    order = {(x.q, x.d): x.position for x in placed.collect()}
    for q in (1, 2, 3):
        best = sorted((w[2], round((2 * w[2] + w[3]) / 3, 6), d) for (x, d), w in want.items() if x == q)
        assert [d for _, _, d in best] == sorted((d for x, d in order if x == q), key=lambda d: order[q, d])


def test_order_bucket_keeps_order(spark):
    values = sorted([0.0, 1e-300, 5e-324, -1.0, -1e-9, 1.0, 1.0000001, 2.0, 1.9999999999999998, 3e8, float("inf"), float("-inf"), 1e308] + [random.Random(6).uniform(-100, 100) for _ in range(200)])
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", rank_aggregation.order_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)


# --- 5 ---


def brute_repeated(data, least=5, share=0.2):
    def wording(line):
        return " ".join("".join(c if c.isalpha() else " " for c in line.lower()).split())

    once = {i: (h, t) for i, h, t in data if i is not None and t is not None}
    held, n = {}, {}
    for i, (h, t) in once.items():
        n[h] = n.get(h, 0) + bool(t.strip())
        for w in {wording(x) for x in t.split("\n")}:
            held.setdefault((h, w), set()).add(i)
    out = set()
    for i, (h, t) in once.items():
        for k, x in enumerate(t.split("\n"), 1):
            w = wording(x)
            if len(w.replace(" ", "")) >= 8 and len(held[h, w]) >= least and len(held[h, w]) >= share * n[h]:
                out.add((i, k))
    return out


def repeated_data():
    r = random.Random(8)
    data = []
    for h in ("a.test", "b.test", None):
        for i in range(30):
            lines = [prose(r, 8) for _ in range(3)] + [f"Share this page with {i} friends"] * (i % 3 == 0) + ["Copyright of everyone here"] * 2 + ["short"] + ["rare line of two pages"] * (i < 4)
            r.shuffle(lines)
            data.append((len(data), h, "\n".join(lines)))
    return data + [(900, "a.test", None), (901, "a.test", " \n "), data[0], data[1]]


def test_repeated_lines_equal_brute_force_and_texts_lose_them(spark):
    data = repeated_data()
    df = spark.createDataFrame(data, "id bigint, host string, text string")
    chosen = repeated_lines.repeated_lines(df, "id", F.col("host"), "text")
    want = brute_repeated(data)
    assert set(rows(chosen)) == want and want
    clean = dict(rows(repeated_lines.without_lines(df, "id", "text", chosen)))
    for i, _, t in data:
        assert clean[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n"), 1) if (i, k) not in want))


def test_lines_of_every_source_are_widespread_and_others_need_excess(spark):
    """A line that fills all sources alike shows no excess; a line of one source does. Cleaning leaves the rest in place."""
    r = random.Random(11)
    own = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(5))
    data = [(h * 100 + i, f"h{h}", f"{own()}\nSubscribe to our letter\n{own()}" + ("\nOnly here we say this" if h == 3 else "")) for h in range(6) for i in range(20)]
    df = spark.createDataFrame(data, "id bigint, host string, text string")
    tests = repeated_lines.tested_lines(df, "id", F.col("host"), "text")
    paths = {(x.source, x.n_in + x.n_out): x.path for x in repeated_lines.chosen_wordings(tests).join(tests, ["source", "h1", "h2"]).collect()}
    assert paths == {**{(f"h{h}", 120): "widespread" for h in range(6)}, ("h3", 20): "excess"}
    clean = dict(rows(repeated_lines.clean_texts(df, "id", F.col("host"), "text")))
    for i, _, t in data:
        x = t.split("\n")
        assert clean[i] == f"{x[0]}\n{x[2]}"


def test_significance_decides_the_lines(spark):
    """p5's plan keeps the test: a wording of the floors that is neither significant nor widespread is left out."""
    tests = spark.createDataFrame([("a", 1, 1, 5, 25, 0, 1000, True), ("a", 2, 2, 5, 25, 0, 1000, False), ("b", 3, 3, 5, 25, 100, 1000, False), ("b", 4, 4, 4, 5, 0, 1000, True)], "source string, h1 bigint, h2 bigint, n_in bigint, records_in bigint, n_out bigint, records_out bigint, significant boolean")
    assert [(x.h1, x.path) for x in repeated_lines.chosen_wordings(tests).orderBy("h1").collect()] == [(1, "excess"), (3, "widespread")]


def test_clean_texts_of_odd_rows(spark):
    line = "This line comes back on every page"
    data = [(i, "a", f"{line}\n{'abcdefgh'[i] * 4} words of this page\n\n{line}") for i in range(8)] + [(20, "a", line), (21, "a", None), (22, "a", ""), (0, "a", f"{line}\naaaa words of this page\n\n{line}"), (None, "a", line)]
    df = spark.createDataFrame(data, "id bigint, host string, text string")
    got = dict(rows(repeated_lines.clean_texts(df, "id", F.col("host"), "text")))
    assert got == {**{i: f"{'abcdefgh'[i] * 4} words of this page\n" for i in range(8)}, 20: "", 21: None, 22: ""}


def test_log_likelihood_and_tail(spark):
    import math

    row = spark.range(1).select(repeated_lines.log_likelihood(*(F.lit(float(x)) for x in (30, 40, 5, 1000))).alias("llr")).withColumn("p", repeated_lines._tail(F.col("llr"))).first()
    xlx = lambda n: n * math.log(n) if n else 0.0
    h = lambda k, n: xlx(k) + xlx(n - k) - xlx(n)
    assert row.llr == pytest.approx(2 * (h(30, 40) + h(5, 1000) - h(35, 1040)))
    assert row.p == pytest.approx(math.log10(math.erfc(math.sqrt(row.llr / 2)) / 2), rel=1e-3)


# --- 6 ---


def test_term_frequencies_equal_brute_force(spark):
    r = random.Random(9)
    terms = ["The", "the ", "café", "café", None, "", "  ", "x" * 41, "1" * 13, "1" * 12, "ö" * 20, "ö" * 21, *VOCABULARY[:40]]
    data = [(r.choice([1, 2, 70_000, 70_001, 5_000_000_000, *range(100, 160)]), r.choice(terms)) for _ in range(4000)] + [(None, "lost"), *((d, "hot") for d in range(6000))]
    got = {x.term: (x.occurrences, x.records, x.mark) for x in term_bitmaps.frequencies(spark.createDataFrame(data, "d bigint, t string").repartition(5), "d", "t").collect()}
    held, every = {}, {d for d, _ in data if d is not None}
    for d, t in data:
        n = None if t is None else unicodedata.normalize("NFC", t).strip().lower()
        if d is not None and n and len(n.encode()) <= 40 and not (n.isdigit() and len(n) > 12):
            held.setdefault(n, []).append(d)
    want = {t: (len(ds), len(set(ds)), "rare" if len(set(ds)) <= 2 else "common" if len(set(ds)) > 0.3 * len(every) else None) for t, ds in held.items()}
    assert got == want


def test_term_frequencies_of_nothing(spark):
    assert rows(term_bitmaps.frequencies(spark.createDataFrame([], "d bigint, t string"), "d", "t")) == []


# --- 7 ---

TEXTS = [None, "", " ", "Hello  world!\n\n it's don't WE'LL '' 's", "日本語 mixed ½² text　end ", "😀 👩‍👩‍👧 é", "<|endoftext|> is text", "a\r\n\tb   c", "x" * 5000, "\x00\x1f'd've", "tail   "]


def test_encoding_equals_the_library_and_decodes(spark):
    r = random.Random(10)
    alphabet = "ab'sS t reve llmd  \n\t\r\x85 é日½²Ⅷ!?.’́\x1c<|endoftext|>😀​"
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(500)]
    tok = tokenizer.encoder(tokenizer.DEFAULT_PATH).tok
    want = tok.encode_batch([t or "" for t in texts], add_special_tokens=False)
    df = tokenizer.encode(frame(spark, list(enumerate(texts))), "id", "text", offsets=True)
    got = {x.id: x for x in df.collect()}
    assert [got[i].ids for i in range(len(texts))] == [e.ids for e in want]
    assert [list(zip(got[i].starts, got[i].ends)) for i in range(len(texts))] == [e.offsets for e in want]
    back = dict(rows(tokenizer.decode(df, "id", "ids")))
    assert [back[i] for i in range(len(texts))] == [t or "" for t in texts]


def test_decoding_odd_ids(spark):
    split = tokenizer.encoder(tokenizer.DEFAULT_PATH).tok.encode("𐍈", add_special_tokens=False).ids
    assert len(split) > 1
    data = [(1, split), (2, split[:1]), (3, None), (4, []), (5, [10**8]), (6, [50256])]
    got = dict(rows(tokenizer.decode(spark.createDataFrame(data, "id bigint, ids array<int>"), "id", "ids")))
    assert got[1] == "𐍈" and set(got[2]) == {"�"} and got[3] is None and got[4] == "" and got[5] == "�" and got[6] == "<|endoftext|>"


# --- 8 ---


def brute_leaks(docs, items, n=13):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words(t)] for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs if t for i, p in items if p and grams(t) & grams(p)}


def test_leaks_equal_brute_force(spark):
    r = random.Random(11)
    items = [(i, prose(r, r.randint(5, 60))) for i in range(20)] + [(50, None), (51, ""), (52, "one two three")]
    docs = []
    for d in range(60):
        parts = [prose(r, r.randint(0, 60))]
        for _ in range(r.randint(0, 2)):
            w = words(r.choice(items[:20])[1])
            n = r.randint(8, 20)
            a = r.randrange(max(1, len(w) - n))
            parts += [" ,".join(w[a : a + n]).upper(), prose(r, r.randint(0, 30))]
        docs.append((d, " -- ".join(parts)))
    docs += ODD + docs[:3]
    want = brute_leaks(docs, items)
    got = leakage.leaks(frame(spark, docs), "id", "text", frame(spark, items), "id", "text")
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want and want
    assert rows(leakage.leaks(frame(spark, []), "id", "text", frame(spark, items), "id", "text")) == []


def test_leaks_are_alike_on_both_join_paths_and_for_repeated_words(spark):
    """A passage that is the document over and over meets it on many alignments, each compared once."""
    r = random.Random(21)
    passage = prose(r, 40)
    docs = [(i, " ".join([prose(r, 5), passage] * (1 + i % 3))) for i in range(12)] + [(50, "a b " * 60), (51, None), (52, passage)]
    items = [(1, passage), (2, "a b " * 30), (3, prose(r, 12)), (4, None), (1, passage)]
    both = [set(rows(leakage.leaks(frame(spark, docs), "id", "text", frame(spark, items), "id", "text", broadcast_rows=n))) for n in (500_000, 0)]
    assert both[0] == both[1] and {(d, i) for d, i, *_ in both[0]} == {(i, 1) for i in range(12)} | {(50, 2), (52, 1)}
    assert max(n for d, i, _, n in both[0] if d == 50) == 60 and {n for d, i, _, n in both[0] if d == 52} == {40}


def test_hash_family_is_spread_evenly():
    """Minima of the universal family estimate similarity without bias."""
    s = near_duplicates.Settings(bands=64, rows=8)
    grams = codepoints.mix(shared_spans.np.arange(3000, dtype="uint64"))
    one, two = grams[:2000], grams[500:2500]
    sig = near_duplicates.signatures(shared_spans.np.concatenate([one, two]), shared_spans.np.array([0, 2000, 4000]), s)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.08


# --- 9 ---


def brute_spans(docs, n):
    seen = {}
    for i, t in docs:
        for k in range(len(t or "") - n + 1):
            seen.setdefault(t[k : k + n], set()).add(i)
    out = set()
    for i, t in docs:
        flags = [False] * len(t or "")
        for k in range(len(t or "") - n + 1):
            if len(seen[t[k : k + n]]) > 1:
                flags[k : k + n] = [True] * n
        k = 0
        while k < len(flags):
            if flags[k]:
                e = k
                while e < len(flags) and flags[e]:
                    e += 1
                out.add((i, k, e))
                k = e
            k += 1
    return out


def span_docs():
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefghij é日😀\n") for _ in range(n))
    pool = [text(80) for _ in range(8)]
    docs = [(0, ""), (1, None), (2, "z" * 100), (3, "z" * 70), (4, pool[0] + pool[0]), (5, pool[1])]
    for d in range(10, 50):
        t = text(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            p = r.choice(pool)
            a = r.randrange(40)
            t += p[a : a + r.randint(20, 60)] + text(r.choice([0, 1, 30]))
        docs.append((d, t))
    return docs + [(60 + i, docs[12][1]) for i in range(20)] + [docs[13]]


@pytest.mark.parametrize("most", [5000, 2])
def test_shared_spans_equal_brute_force(spark, most):
    docs = span_docs()
    got = shared_spans.shared_spans(frame(spark, docs), "id", "text", length=40, gram=16, most_contexts=most)
    want = brute_spans(docs, 40)
    assert set(rows(got)) == want and want


def test_shared_spans_of_nothing(spark):
    assert rows(shared_spans.shared_spans(frame(spark, ODD), "id", "text")) == []
    assert rows(shared_spans.shared_spans(frame(spark, []), "id", "text")) == []


# --- kernels ---


def test_words_and_slices():
    import pyarrow as pa

    texts = ["One, two—THREE4 five_six", None, "", "日本 x", "ÀÉ", "a"]
    cps, off = codepoints.code_points(pa.array(texts))
    start, end, first = codepoints.word_bounds(cps, off)
    whole = cps.tobytes().decode("utf-32-le")
    assert [[whole[a:z].lower() for a, z in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])] for i in range(len(texts))] == [words(t) for t in texts]
    assert list(codepoints.slices(pa.array(["x" * 500_000, "y", None, "z"]))) == [(0, 1), (1, 4)]


def test_winnow_keeps_one_of_every_window():
    import numpy as np

    r = np.random.default_rng(13)
    h = r.integers(1, 50, 200).astype(np.uint64)
    at = set(codepoints.winnow(h, np.full(200, 200), 7).tolist())
    assert all(at & {i + int(k) for k in np.flatnonzero(h[i : i + 7] == h[i : i + 7].min())} for i in range(194))


def test_parse_gives_the_longest_factors_and_loses_no_window():
    """Against brute force: every window that another record holds about the same anchor lies in a factor, every factor
    stands in its source, and none can be made longer to the right from where it begins."""
    r = random.Random(31)
    length = 12
    for _ in range(60):
        blocks, chars, before, low, high = [], [], [], [], []
        for b in range(r.randint(1, 3)):
            middle = "".join(r.choice("ab") for _ in range(6))
            for _ in range(r.randint(1, 9)):
                left, right = ("".join(r.choice("ab") if r.random() < 0.15 else c for c in "abbabaab"[: r.randint(0, 8)]) for _ in range(2))
                left, right = left[::-1], right
                i = r.randint(1, 5)
                blocks.append(b), chars.append(left + middle + right), before.append(len(left)), low.append(i), high.append(i + (r.random() < 0.2))
        n = len(chars)
        own, first, last, source = shared_spans.parse(*(shared_spans.np.array(x, "int64") if x is not chars else x for x in (blocks, chars, before, low, high)), length)
        found = {}
        for c, s, e, o in zip(own, first, last, source):
            assert low[c] == high[c] and (low[o] != high[o] or low[o] != low[c]) and e - s >= length
            shift = before[o] - before[c]
            assert blocks[o] == blocks[c] and chars[o][s + shift : e + shift] == chars[c][s:e]
            longest = max((k for d in range(n) if blocks[d] == blocks[c] and (low[d] != high[d] or low[d] != low[c]) and s + before[d] - before[c] >= 0 for k in range(length, len(chars[c]) - s + 1) if chars[d][s + before[d] - before[c] :][:k] == chars[c][s:][:k] and len(chars[d][s + before[d] - before[c] :]) >= k), default=0)
            assert e - s == longest
            found.setdefault(c, set()).update(range(s, e - length + 1))
        for c in range(n):
            want = set()
            for s in range(len(chars[c]) - length + 1):
                at = [s + before[d] - before[c] if blocks[d] == blocks[c] and (low[d] != high[d] or low[d] != low[c]) else -1 for d in range(n)]
                if any(a >= 0 and chars[d][a : a + length] == chars[c][s : s + length] for d, a in enumerate(at)):
                    want.add(s)
            assert found.get(c, set()) == (want if low[c] == high[c] else set())
