"""Operators of quireflow.llm against brute force, exact round trips, other encoders and SQL."""

import base64
import math
import random
import re
import sys
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0] + "/tests")
from conftest import SF, rows_of  # noqa: E402
from quireflow.llm import bpe, catalog, markup, near, packing, spans, splitting  # noqa: E402
from quireflow.llm.encode_queries import token_counts, token_ids  # noqa: E402
from quireflow.llm.markup_queries import clean_texts  # noqa: E402
from quireflow.llm.term_scores import term_scores  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(name, spark, sql):
    assert rows_of(catalog.QUERIES[name](spark, SF).toPandas()) == rows_of(sql(catalog.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0


# --- 1: term scores -------------------------------------------------------------------------------------------------


def test_term_scores(spark):
    rows = [("a", "Red red door", "door 5x x5", 1), ("a", "Red red door", "door 5x x5", 2), ("b", None, "RED Éclair", 1), ("c", "", None, 1), (None, "red", "", 1), ("d", "_red-wheel_", "wheel", None)]
    rows = [(k, a, b, t, "clash", "clash", 7) for k, a, b, t in rows]
    df = spark.createDataFrame(rows, "id string, x string, y string, ingested_at int, term string, df string, n int")
    got = {(r["id"], r["term"]): (r["tf"], r["df"], r["score"]) for r in term_scores(df, "id", ["x", "y"]).collect()}
    texts = {"a": "red red door door", "b": "red éclair", "d": "red wheel wheel"}
    docs = {k: Counter(v.split()) for k, v in texts.items()}
    n, mean = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    dfs = Counter(t for d in docs.values() for t in d)
    for k, d in docs.items():
        for t, tf in d.items():
            score = math.log(1 + (n - dfs[t] + 0.5) / (dfs[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean))
            assert got.pop((k, t)) == (tf, dfs[t], pytest.approx(score))
    assert not got
    assert term_scores(df.limit(0), "id", ["x", "y"]).count() == 0


def test_cold_terms_are_found_beside_hot_ones(spark):
    spell = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    rows = [(str(i), f"the w{spell(i)} w{spell(i)} p{spell(i // 2)}", "", 1) for i in range(600)]
    got = term_scores(spark.createDataFrame(rows, "id string, x string, y string, ingested_at int"), "id", ["x", "y"]).collect()
    assert {(r["id"], r["term"]): (r["tf"], r["df"]) for r in got} == {
        k: v for i in range(600) for k, v in (((str(i), "the"), (1, 600)), ((str(i), f"w{spell(i)}"), (2, 1)), ((str(i), f"p{spell(i // 2)}"), (1, 2)))
    }


# --- 2: splitting ---------------------------------------------------------------------------------------------------


def check_pieces(text, limit=200, overlap=(20, 40)):
    parts = splitting.split(text, limit, overlap)
    bare = text.strip(splitting.BLANK)
    assert "".join(text[c:z] for _, c, z in parts) == bare
    for i, (a, c, z) in enumerate(parts):
        assert z - a <= limit and z > c
        assert (overlap[0] <= c - a <= overlap[1]) if i else a == c
    return parts


def test_split_round_trips():
    random.seed(4)
    assert splitting.split("", 200, (20, 40)) == splitting.split(" \n", 200, (20, 40)) == []
    assert len(check_pieces("x" * 200)) == 1 and len(check_pieces(" " + "x" * 200 + "\n")) == 1 and len(check_pieces("x" * 201)) == 2
    for alphabet in ("ab. \n", "a", "ab ", "é😀中。\n", "word. Next! \n"):
        for _ in range(60):
            check_pieces("".join(random.choices(alphabet, k=random.randint(0, 900))))


def test_split_takes_natural_and_deepest_boundaries():
    one = "The red door handle opens the red door. " * 3
    two = "Blue wheel nuts hold blue wheels well. " * 4
    parts = check_pieces(one + two)
    assert parts[0][2] == len(one)  # where the topic changes
    words = "word " * 100
    assert all(words[z - 1] == " " for _, _, z in check_pieces(words)[:-1])


@pytest.mark.parametrize("text", ["Title line\n" + "word " * 400, "One. " + "x" * 2000, "ab " + "x" * 2000, " \nFirst one.\n" + "字" * 2000, "a" * 130 + ".\n" + "b" * 2000])
def test_split_after_a_short_first_line_loses_nothing(text):
    whole, at = text.strip(splitting.BLANK), 0
    parts = splitting.split(text)
    for a, c, z in parts:
        piece = text[a:z]
        assert 0 < len(piece) <= splitting.LIMIT and (c == a or splitting.OVERLAP[0] <= c - a <= splitting.OVERLAP[1])
        assert piece[c - a :] == whole[at : at + z - c] and whole[: at + z - c].endswith(piece)
        at += z - c
    assert at == len(whole)


def test_pieces_with_sources(spark):
    body = ["First element says something. " * 30, "Second one says more about it. " * 30, "Third."]
    text = "\n".join(b.strip() for b in body)
    rows = [("c", text, ["e1", "e2", "gone", "", None, "e1"], [1, 2], 1, "clash"), ("c", text, ["e1", "e2", "gone", "", None, "e1"], [1, 2], 2, "clash"), ("s", "short", None, None, 1, ""), ("n", None, ["e1"], [1], 1, ""), ("b", " \n", [], [], 1, "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, content string, element_ids array<string>, page_nos array<int>, ingested_at int, piece string")
    elements = spark.createDataFrame([("e1", body[0], 4, 1, "x"), ("e2", body[1], None, 1, "x")], "element_id string, content string, page_no int, ingested_at int, place string")
    got = sorted(splitting.pieces_with_sources(chunks, elements).collect(), key=lambda r: (r.chunk_id, r.piece_no))
    assert [r.chunk_id for r in got] == ["c"] * (len(got) - 1) + ["s"]
    assert got[0].element_ids == ["e1"] and got[0].page_nos == [4]
    assert got[-2].element_ids[-2:] == ["e2", "gone"] and got[-1].element_ids == [] and got[-1].page_nos == []
    assert splitting.pieces_with_sources(chunks.limit(0), elements).count() == 0


# --- 3: near duplicates ---------------------------------------------------------------------------------------------


def brute_pairs(records, words, similarity, least):
    sets = {}
    for space, key, text in records:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        if key is not None and len(w) >= max(words, least):
            sets[space, key] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    keys = sorted(sets)
    return {(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}


def variants(seed, n, vocabulary):
    rng = random.Random(seed)
    out = []
    for g in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 8, 12, 30, 45, 90]))]
        for _ in range(rng.randint(1, 5)):
            w = base[:]
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                i = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(i, rng.choice(vocabulary)), lambda: w.insert(i, "new"), lambda: len(w) > 3 and w.pop(i), lambda: w.__setitem__(slice(None), w[i:] + w[:i])])()
            out.append((rng.choice("pq"), f"{g:03}-{len(out):03}", " ".join(w)))
    return out


@pytest.mark.parametrize(("words", "similarity", "least"), [(3, 0.7, 3), (5, 0.8, 5), (1, 0.7, 1)])
def test_near_pairs_are_those_of_brute_force(spark, words, similarity, least):
    records = variants(7, 60, [f"w{i}" for i in range(50)] + ["the"] * 30)
    records += [("p", "copy1", records[0][2].upper()), ("p", None, "x"), ("p", "null", None), ("p", "empty", ""), ("p", "same", "a " * 60), ("p", "same2", "a " * 90), records[0]]
    df = spark.createDataFrame([(*r, "clash", 1) for r in records], "space string, id string, text string, tokens string, n int")
    got = {tuple(r) for r in near.near_pairs(df, words, similarity, least).collect()}
    want = brute_pairs(records, words, similarity, least)
    assert len(want) > 20 and got == want
    assert near.near_pairs(df.limit(0), words, similarity, least).count() == 0


@pytest.mark.parametrize(("similarity", "size", "vocabulary"), [(0.2, 45, 135), (0.3, 30, 70), (0.55, 18, 24)])
def test_near_pairs_of_low_similarity_are_those_of_brute_force(spark, similarity, size, vocabulary):
    rng = random.Random(12)
    records = [("p", f"{i:03}", " ".join(rng.sample([f"w{j}" for j in range(vocabulary)], size))) for i in range(80)]
    want = brute_pairs(records, 1, similarity, 1)
    got = {tuple(r) for r in near.near_pairs(spark.createDataFrame(records, "space string, id string, text string"), 1, similarity, 1).collect()}
    print(similarity, "true pairs", len(want), "found", len(got & want))
    assert len(want) > 100 and got == want


def test_near_needs_a_similarity_above_0(spark):
    with pytest.raises(ValueError):
        near.near_pairs(spark.createDataFrame([("p", "a", "x y")], "space string, id string, text string"), 1, 0, 1)


def test_near_classes(spark):
    records = variants(9, 40, [f"w{i}" for i in range(60)])
    df = spark.createDataFrame(records, "space string, id string, text string")
    rows = near.near_classes(df, 3, 0.7, 3).collect()
    root = {(r.space, r.id): (r.space, r.id) for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for s, a, b in brute_pairs(records, 3, 0.7, 3):
        root[max(find((s, a)), find((s, b)))] = min(find((s, a)), find((s, b)))
    assert {(r.space, r.id): (r.space, r.class_id) for r in rows} == {k: find(k) for k in root}


def test_long_chain_is_one_class(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)] + [(500, 501), (5, 5)], "a bigint, b bigint")
    got = {r.node: r["class"] for r in near.classes_of(edges).collect()}
    assert got == {**dict.fromkeys(range(121), 0), 500: 500, 501: 500}


def test_walk_prunes_nothing_it_needs():
    rng = random.Random(1)
    for _ in range(200):
        sets = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(8)]
        probe, rest = sets[0], sets[1:]
        got = dict(near.walk(np.array(probe), [np.array(s) for s in rest], 0.5))
        want = {i: len(set(probe) & set(s)) for i, s in enumerate(rest) if len(set(probe) & set(s)) >= 0.5 * len(set(probe) | set(s)) - 1e-9}
        assert got == want


# --- 4: markup ------------------------------------------------------------------------------------------------------

PLAIN = [
    "1. Open the door.\n2) Close it.", "• keep dry", "to – see above – be", "value < 249 kPa and > 101 kPa", "The kit costs $84 plus $4 for the seal.", "37 mm*; 40 mm*. * < 5 % tolerance",
    "See fuse #46 (12 V*).", r"The file C:\LOG\trip_61.txt holds key_7.", "Press <OK> and then <SET>, <MENU> or <MODE>.", "Enter {VIN} here.", "Area = 7 * 69 mm.", "a | b | c\nd | e | f",
    "Lock & unlock; R&D", "a\tb\nc\td", '"a","b"\n"c","d"', "Fits all trims* (* not with trailer).", "See figure [10] and note 2).", "Ratio ~3:1", "5 = 4 + 1", 'Wheel\' s marks are "B" and \'C\'.', "Section: A > B", "", None,
]
MARKED = [
    ("<p>Hi <b>you</b></p>", "html", "Hi you"), ("a<br>b", "html", "a\nb"), ("19&#8239;L", "html", "19 L"), ("&lt;p&gt;x&lt;/p&gt;", "html", "x"), ("x <!-- todo -->", "html", "x"),
    ("<h2>T</h2>\n<ul><li>a<li>b</ul>", "html", "## T\n- a\n- b"), ("<ol><li>a</li><li>b</li></ol>", "html", "1. a\n2. b"), ("<table><tr><th>A<th>B<tr><td>1<td>2</table>", "html", "A | B\n1 | 2"),
    ("<pre><code>x = 1\n  y</code></pre>", "html", "```\nx = 1\n  y\n```"), ("x <code>y</code>", "html", "x `y`"), ("<script>no</script>yes <OK>", "html", "yes <OK>"),
    ("## T\nx", "markdown", "## T\nx"), ("T\n====\nx", "markdown", "# T\nx"), ("a **b** *c* __d__", "markdown", "a b c d"), ("[a](b.md) ![c](d.png)", "markdown", "a c"), ("> q", "markdown", "q"),
    ("* a\n+ b\n- c", "markdown", "- a\n- b\n- c"), ("| A | B |\n|---|:-:|\n| 1 | 2 |", "markdown", "A | B\n1 | 2"), ("```\n*x*\n```", "markdown", "```\n*x*\n```"), ("use `a*b*c`", "markdown", "use `a*b*c`"),
    ("== T ==\n''x'' '''y'''", "wiki", "## T\nx y"), ("[[a]] [[b|c]]", "wiki", "a c"), ("[[File:f.svg|thumb|c d]]", "wiki", "c d"), ("{{note|a b}}", "wiki", "a b"), ("{| class=x\n! A !! B\n|-\n| 1 || 2\n|}", "wiki", "A | B\n1 | 2"),
    (r"\section{T} \textbf{x}", "latex", "# T\n x"), ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "latex", "- a\n- b"), (r"$M_{3} = 4$", "latex", "$M_{3} = 4$"), (r"\[ r = \frac{1}{2} \]", "latex", r"$r = \frac{1}{2}$"),
    ("\\begin{tabular}{l|r}\n\\hline\na & 5~V \\\\\nb & 6 \\\\\n\\end{tabular}", "latex", "a | 5 V\nb | 6"), (r"\SI{5}{\newton\metre}", "latex", "5 newton metre"), (r"x\footnote{n} \ref{t}", "latex", "xn"),
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_unchanged(text):
    assert markup.clean(text) == (text, [])


@pytest.mark.parametrize(("text", "kind", "want"), MARKED)
def test_markup(text, kind, want):
    got, kinds = markup.clean(text)
    assert kind in kinds and [x.strip() for x in got.split("\n")] == [x.strip() for x in want.split("\n")]


def test_links_alone_are_left_out_of_content():
    menu = "".join(f'<a href="{i}">item {i}</a><br>' for i in range(12))
    prose = "<p>" + "A long sentence of real content. " * 20 + "</p>"
    got, _ = markup.clean(f"<div>{menu}</div>{prose * 4}")
    assert "item 3" not in got and got.count("real content") == 80


def test_clean_unwraps_any_nesting():
    deep = "deep"
    for _ in range(9):
        deep = "\\textbf{" + deep + "}"
    assert markup.clean("Some " + deep + " text")[0] == "Some deep text"
    assert markup.clean("Some {{a|{{b|{{c|deep}}}}}} text")[0] == "Some deep text"


KEPT = [
    ("Text with `<b>` tag shown and **bold**", "Text with `<b>` tag shown and bold"), ("```\n<b>x</b>\n```\nafter <i>y</i>", "```\n<b>x</b>\n```\nafter y"),
    ("<pre>\\textbf{x}</pre>", "```\n\\textbf{x}\n```"), ("<code>**a**</code>", "`**a**`"), ("x^2 \\frac{1}{2} holds", "x^2 $\\frac{1}{2}$ holds"), ("\\sqrt{a+b}", "$\\sqrt{a+b}$"),
    ("{{Warning|text=Hot}}", "Warning: text=Hot"), ("a <svg><path d='x'/></svg> b", "a  b"), ("- 5 bolts\n- 3 nuts", "- 5 bolts\n- 3 nuts"), ("> 5 turns\n> 6 turns", "5 turns\n6 turns"),
    ("<html><head><title>x<body>Hello</body>", "Hello"), ("a <noscript>rest", "a rest"), ("<math>x</math> <b>q</b>", "$x$ q"),
]


@pytest.mark.parametrize(("text", "want"), KEPT)
def test_code_and_formulas_are_kept(text, want):
    got, found = markup.clean(text)
    assert found and got == want


def test_clean_texts(spark):
    df = spark.createDataFrame([("a", "1", "<b>x</b>", 1), ("a", "2", None, 2), ("a", "2", None, 2), (None, None, "y" * 100_000, 3)], "space string, id string, text string, kinds int")
    got = Counter((r.space, r.id, r.text, r.kinds) for r in clean_texts(df).collect())
    assert got == Counter({("a", "1", "x", "html"): 1, ("a", "2", None, ""): 2, (None, None, "y" * 100_000, ""): 1})
    assert clean_texts(df.limit(0)).count() == 0


# --- 6: encoding ----------------------------------------------------------------------------------------------------

VOCABULARY = bpe.DEFAULT_FOLDER + "/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), list(ranks)


def test_ids_are_those_of_the_public_encoder(reference):
    other, tokens = reference
    mine, rng = bpe.text_encoder("byte_bpe_50k"), random.Random(5)
    parts = ["a", " ", "\n", "1", "²", "é", "中", "'s", "'", "!", "\x1c", "\u3000", "\u200b", "the", "İ", "\xa0", "\t", "x" * 50, "=-" * 40, "😀", "<|endoftext|>", "\r\n", "ﬁ", "e\u0301"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        assert mine.encode(text) == other.encode_ordinary(text), repr(text)
    for _ in range(3000):
        text = "".join(t.decode("utf-8", "ignore") for t in rng.choices(tokens, k=3))
        assert mine.encode(text) == other.encode_ordinary(text), repr(text)


def test_pieces_agree_with_the_published_pattern():
    import public_tokenizers
    import regex

    mine, other = bpe.piece_pattern(), regex.compile(public_tokenizers.PATTERN)
    for p in range(0, sys.maxunicode + 1):
        if unicodedata.category(chr(p)) not in ("Cn", "Cs"):  # of the standard library's Unicode version
            text = f"a{chr(p)} {chr(p)}1"
            assert mine.findall(text) == other.findall(text), hex(p)


def test_token_ids(spark):
    rows = [(1, "Hello world", 1), (2, "", 1), (3, None, 1), (1, "Hello world", 2), (None, "x", 1), (4, "word " * 50_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = Counter((r.doc_id, len(r.ids)) for r in token_ids(df, "doc_id", "text").collect())
    assert got == Counter({(1, 2): 2, (2, 0): 1, (3, 0): 1, (None, 1): 1, (4, 50_001): 1})
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0
    assert {r.doc_id for r in token_counts(df.unionByName(spark.createDataFrame([(9, " \n\u3000", 1)], df.schema)), "doc_id", "text").collect()} == {1, None, 4}


# --- 7: packing -----------------------------------------------------------------------------------------------------


def test_sum_of_squares_is_least_at_each_step():
    rng = random.Random(2)
    sizes = np.array([rng.randint(1, 12) for _ in range(80)])
    got = packing.sum_of_squares(sizes, 12)
    gaps: dict[int, int] = {}
    value = lambda g: sum(c * c for k, c in Counter(g.values()).items() if k)
    for i in np.argsort(-sizes, kind="stable"):
        options = [{**gaps, "new": 12 - sizes[i]}, *({**gaps, b: g - sizes[i]} for b, g in gaps.items() if g >= sizes[i])]
        gaps[int(got[i])] = gaps.get(int(got[i]), 12) - int(sizes[i])
        assert value(gaps) == min(map(value, options))
    assert min(gaps.values()) >= 0


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 7, 30, 64, 65, 200, 3]), "clash") for i in range(500)] + [(1000, 0, ""), (1001, None, ""), (None, 5, "")]
    df = spark.createDataFrame(rows, "id bigint, size int, shard string")
    got = packing.pack(df, "id", "size", 500, 64).toPandas()
    whole = got.sort_values(["id", "piece_no"]).groupby("id")
    assert {k: int(g["length"].sum()) for k, g in whole} == {i: n for i, n, _ in rows[:500]}
    assert all((g["first"].to_numpy() == np.cumsum([0, *g["length"]])[:-1]).all() for _, g in whole)
    assert (whole.size() == 1).all() or all(len(g) == -(-g["length"].sum() // 64) for _, g in whole)
    use = got.groupby("container_id")["length"].sum()
    assert use.max() <= 64 and len(use) <= math.ceil(got["length"].sum() / 64) * 1.02 + 1
    assert packing.pack(df.limit(0), "id", "size", 0, 64).count() == 0


# --- 8: shared stretches --------------------------------------------------------------------------------------------


def brute_stretches(texts, span):
    where = defaultdict(set)
    for k, t in texts.items():
        for i in range(len(t or "") - span + 1):
            where[t[i : i + span]].add(k)
    out = set()
    for k, t in texts.items():
        at = [i for i in range(len(t or "") - span + 1) if len(where[t[i : i + span]]) > 1]
        start = prev = None
        for i in at:
            if prev is None or i > prev + span:
                if prev is not None:
                    out.add((k, start, prev - start + span))
                start = i
            prev = i
        if prev is not None:
            out.add((k, start, prev - start + span))
    return out


def test_stretches_are_those_of_brute_force(spark):
    rng, span = random.Random(6), 40
    word = lambda n, a="abcdefgh é😀\n": "".join(rng.choices(a, k=n))
    passages = [word(n) for n in (39, 40, 41, 55, 80, 200)]
    texts = {i: word(rng.randint(0, 150)) + rng.choice(passages) + word(rng.randint(0, 150)) for i in range(60)}
    texts |= {100: None, 101: "", 102: "short", 103: "=" * 500, 104: "x" + "=" * 300, 105: word(60) * 3, 106: texts[0], 107: texts[0][5:60], 108: "-=" * 100, 109: "=-" * 90 + word(20)}
    df = spark.createDataFrame([(k, t, 1, "clash") for k, t in texts.items()] + [(None, passages[5], 1, "")], "id bigint, text string, at int, digest string")
    got = {tuple(r) for r in spans.shared_stretches(df, "id", "text", span, window=12, anchor=12).collect()}
    want = brute_stretches(texts, span)
    assert len(want) > 30 and got == want
    assert spans.shared_stretches(df.limit(0), "id", "text").count() == 0
    with pytest.raises(ValueError):
        spans.shared_stretches(df, "id", "text", 40)


@pytest.mark.parametrize("window", [12, 128, 129, 300, 1000])
def test_cut_of_a_window_is_its_least_hash(window):
    h = spans.Hashed(["".join(random.Random(9).choices("abcdefgh é😀", k=3_000))])
    hashes = h._gear_hashes()
    want = [i + int(np.argmin(hashes[i : i + window])) + 1 for i in range(len(hashes) - window + 1)]
    assert h.cut_of(window).tolist() == want and set(want) <= set(h.cuts(window).tolist())


def test_stretches_of_a_wide_window_are_those_of_brute_force(spark):
    rng, span = random.Random(10), 400
    word = lambda n: "".join(rng.choices("abcdefgh é😀", k=n))
    passages = [word(n) for n in (399, 400, 401, 600)]
    texts = {i: word(rng.randint(0, 300)) + passages[i % 4] + word(rng.randint(0, 300)) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = {tuple(r) for r in spans.shared_stretches(df, "id", "text", span, window=300, anchor=80).collect()}
    want = brute_stretches(texts, span)
    print("true stretches", len(want), "found", len(got & want))
    assert len(want) > 20 and got == want


def test_every_span_holds_a_common_cut():
    rng = random.Random(8)
    for _ in range(300):
        passage = "".join(rng.choices("ab ", k=spans.SPAN))
        digests = []
        for _ in range(2):
            text = "".join(rng.choices("ab ", k=rng.randint(0, 300))) + passage + "".join(rng.choices("ab ", k=rng.randint(0, 300)))
            h = spans.Hashed([text])
            cut = h.cuts(spans.WINDOW)
            digests.append(set(h.digests(cut[cut + spans.ANCHOR <= len(text)], spans.ANCHOR).tolist()))
        assert digests[0] & digests[1]


# --- hot keys and low similarities --------------------------------------------------------------------------------------


def _jaccard_pairs(rows, words, similarity, least):
    import itertools
    import re

    sets = {}
    for space, key, text in rows:
        w = re.findall(r"[^\W_]+", text.lower())
        if len(w) >= max(words, least):
            sets[space, key] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
    out = set()
    for (a, x), (b, y) in itertools.combinations(sorted(sets.items()), 2):
        if a[0] == b[0] and len(x & y) >= similarity * len(x | y) - 1e-9:
            out.add((a[0], a[1], b[1]))
    return out


@pytest.mark.parametrize("similarity", [0.4, 0.5, 0.6, 0.8])
def test_near_pairs_are_those_of_brute_force_with_hot_keys(spark, monkeypatch, similarity):
    import random

    monkeypatch.setattr(near, "HOT_CLASS", 2)  # so that the split of hot keys is taken
    rnd = random.Random(7)
    base = [rnd.choice("abcdefghijkl") + str(rnd.randrange(9)) for _ in range(60)]
    rows = []
    for i in range(60):
        w = list(base) if i % 3 == 0 else [rnd.choice("abcdefghijkl") + str(rnd.randrange(9)) for _ in range(60)]
        for _ in range(rnd.randrange(0, 25)):
            w[rnd.randrange(60)] = "edit" + str(rnd.randrange(1000))
        rows.append(("s", f"k{i:02d}", " ".join(w)))
    rows.append(("s", "half", " ".join(base[::2])))
    got = {(r.space, r.id_a, r.id_b) for r in near.near_pairs(spark.createDataFrame(rows, "space string, id string, text string"), 1, similarity, 5).collect()}
    assert got == _jaccard_pairs(rows, 1, similarity, 5) and got


def test_a_passage_of_a_third_of_all_documents_is_resolved_in_the_workers(spark, monkeypatch):
    import random

    from quireflow.llm import spans as S

    monkeypatch.setattr(S, "RESOLVED_AT_ONCE", 2_000)
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    hot = text(260)
    rows = [(i, text(50 + i) + (hot if i % 3 == 0 else text(260)) + text(40)) for i in range(60)] + [(100, None), (101, ""), (102, hot[:199])]
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(3)
    got = {r.k: (r["first"], r.length) for r in S.shared_stretches(df, "k", "t").collect()}
    assert set(got) == {i for i in range(60) if i % 3 == 0}
    assert all(at <= 50 + k and at + n >= 50 + k + 260 for k, (at, n) in got.items())


def test_further_bits_tell_equal_digests_apart():
    from quireflow.llm import spans as S

    digest, check, key = np.array([5, 5, 5, 7]), np.array([1, 2, 1, 0]), np.array([1, 2, 3, 3])
    known, stand = S._resolved(digest, check, key)
    assert known.tolist() == [True, False, True, False] and sorted(key[stand]) == [1, 3]
