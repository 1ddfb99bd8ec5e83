"""Operators that read one text at a time, against brute force."""

import hashlib
import random
import re
import time

import public_tokenizers
import pytest
import regex

from docloom.llm import bpe, html_extract, pii, quality_rules

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
DOCS = "doc_id long, text string, score string, key string, ids string, lang_pred string"


def docs(spark, texts):
    """Texts with ids, and further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "s", "k", "x", "y") for i, t in enumerate(texts)], DOCS)


# --- BPE ---


def test_pieces_join_to_the_ids_of_the_whole():
    ranks = bpe.load_ranks(RANKS)
    enc = bpe.encoding(ranks, PATTERN)
    rng = random.Random(3)
    bits = ["word", " ", "  ", "\n", "'s", "don't", "1234", "é", "日本", "。", "　", "!?", " ", "\x1c", "I'll", "\t", "x" * 30]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(400))
        assert bpe.encode_text(text, ranks, PATTERN, chunk=7).tolist() == enc.encode_ordinary(text)
    assert list(bpe.pieces("a" * 50, 10)) == ["a" * 50]
    assert "".join(bpe.pieces("ab cd " * 50, 10)) == "ab cd " * 50


def test_each_match_of_the_pattern_is_encoded_by_itself():
    ranks = bpe.load_ranks(RANKS)
    enc = bpe.encoding(ranks, PATTERN)
    text = "It's 12 o'clock,\n\n  naïve  日本語!! <|endoftext|> "
    own = [i for m in regex.findall(PATTERN, text) for i in enc._encode_single_piece(m)]
    assert bpe.encode_text(text, ranks, PATTERN).tolist() == own


def test_bpe_rows(spark):
    texts = ["Hello world", None, "", "a " * 70000, "x" * 100000, "same", "same", "é\u0000\U0001f600"]
    df = docs(spark, texts)
    enc = bpe.encoding(bpe.load_ranks(RANKS), PATTERN)
    for r in bpe.digests(df, RANKS, PATTERN).collect():
        text = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back.collect())
    assert bpe.digests(df.limit(0), RANKS, PATTERN).count() == 0


# --- personal data ---

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_regular_expressions():
    rng = random.Random(5)
    for alphabet in ("a.@0129+- (1.@", "4111 -", "1.25", "a@b.c", "+1 ()-.23"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(45))
            assert pii.detect(text) == base_spans(text), text


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write john[at]example[dot]com now", "email", "john[at]example[dot]com"),
        ("write john (at) example (dot) com", "email", "john (at) example (dot) com"),
        ("write john dot doe at example dot com.", "email", "john dot doe at example dot com"),
        ("x jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("x foo&#64;bar.com", "email", "foo&#64;bar.com"),
        ("x １２.1.1.１ y", "ip", "１２.1.1.１"),
        ("host 192[.]168[.]1[.]1 up", "ip", "192[.]168[.]1[.]1"),
        ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
        ("call +1 (nine seven four) five five five - three four three six now", "phone", "+1 (nine seven four) five five five - three four three six"),
        ("dial plus 1 974 555 3436 x", "phone", "plus 1 974 555 3436"),
        ("card 4O12 8888 88B8 l88l ok", "card", "4O12 8888 88B8 l88l"),
        ("jane DOT doe AT mail3 DOT example DOT com", "email", "jane DOT doe AT mail3 DOT example DOT com"),
        ("x jane_at_mail_dot_org y", "email", "jane_at_mail_dot_org"),
        ("pay four one one one 1111 1111 1111 now", "card", "four one one one 1111 1111 1111"),
    ],
)
def test_disguises_are_found_at_their_source(text, kind, found):
    base, added = pii.find(text)
    assert (kind, found) in [(k, text[a:b]) for k, a, b in base + added]
    assert added


@pytest.mark.parametrize("text", ["meet me at the dot on the map", "one two three four five", "she arrived at example.com", "un deux trois", "3 @ 5.00", "mail a.b@c.de now", "a plus 10 15 20 25 30 b", "+1 (974) 555-3436 Un deux", "So 4111111111111111 Il", "look-at-me"])
def test_clean_texts_gain_nothing(text):
    assert pii.find(text)[1] == []


def test_base_spans_stay_and_long_texts_are_linear():
    for text in ("1" * 200000, "a" * 200000, "a.b" * 60000, "+1" * 60000, "one " * 50000, "a at b dot " * 20000, "a@" * 80000, "(at)" * 50000):
        began = time.time()
        base, _ = pii.find(text)
        assert base == pii.detect(text)
        assert time.time() - began < 5


def test_pii_rows(spark):
    texts = ["a@b.co and 10.0.0.1", None, "", "a@b.co", "a@b.co", "j[at]x[dot]org +1 (974) 555-3436"]
    rows = {r["doc_id"]: r for r in pii.digests(docs(spark, texts)).collect()}
    assert rows[0]["n_email"] == 1 and rows[0]["n_ip"] == 1 and rows[0]["spans"] == "email:0:6,ip:11:19"
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[1]["base_sha256"] == rows[2]["base_sha256"] == empty and rows[1]["spans"] == ""
    assert rows[3]["base_sha256"] == rows[4]["base_sha256"]
    assert rows[5]["n_email"] == 0 and rows[5]["spans"].startswith("email:0:14,phone:15:") and rows[5]["n_added"] == 1
    assert all(r["has_pii"] == (r["spans"] != "") for r in rows.values()) and rows[5]["has_pii"]
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, texts)).collect()}
    assert masked[0] == "[EMAIL] and [IP]" and masked[1] is None and masked[5] == "[EMAIL] [PHONE]"
    assert pii.mask("abcdef", [("email", 1, 4), ("ip", 2, 5)]) == "a[EMAIL]f"
    assert [len(r["pii_spans"]) for r in pii.find_spans(docs(spark, texts)).orderBy("doc_id").collect()] == [2, 0, 0, 1, 1, 2]
    assert pii.digests(docs(spark, texts).limit(0)).count() == 0


# --- quality rules ---


def counted(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_equal_brute_force(spark):
    rng = random.Random(7)
    texts = ["", None, " \n\t", " x", "a" * 5000] + ["".join(rng.choice(("a ", "b ", "c\n", "é# ", "\x0b")) for _ in range(rng.randint(1, 90))) for _ in range(120)]
    texts += ["one two three four five six seven eight " * 5000, "w " * 19, "v " * 20, " ".join(map(str, range(400)))]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60)] + [(3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    ratio = quality_rules.fit(quality_rules.trusted(df, labels))
    for r in quality_rules.judge(df, ratio).collect():
        text = texts[r["doc_id"]] or ""
        n, chars, symbols, dup, repeat = counted(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat), text[:80]
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["base_failed"] and r["kept"])


def test_likelihood_ratio_equals_a_plain_count(spark):
    texts = ["a b c " * 10, "a b x y " * 8, "x y z " * 9]
    df = docs(spark, texts)
    ratio = quality_rules.fit(quality_rules.trusted(df, spark.createDataFrame([(0, 1), (0, 1)], "doc_id long, quality int")))
    words = quality_rules.number_words([t.encode() for t in texts])
    one, two = quality_rules.grams(words)
    import numpy as np

    raw, target = np.zeros(quality_rules.BUCKETS + 1), np.zeros(quality_rules.BUCKETS + 1)
    for d in range(3):
        for k in range(words.start[d], words.start[d + 1]):
            raw[one[k]] += 1
            raw[two[k]] += 1
            if d == 0:
                target[one[k]] += 1
                target[two[k]] += 1
    raw, target = raw[:-1], target[:-1]
    plain = np.log((target + 1) / (target.sum() + quality_rules.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality_rules.BUCKETS))
    assert np.allclose(plain, ratio)
    llr = {r["doc_id"]: r["llr"] for r in quality_rules.judge(df, ratio).collect()}
    assert llr[0] > llr[1] > llr[2]
    none = quality_rules.fit(quality_rules.trusted(df, spark.createDataFrame([], "doc_id long, quality int")))
    assert not none.any()


# --- HTML ---


def page(article, extra=""):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=x>Menu</a></nav>{extra}<article>{article}</article><aside>side</aside><form>f</form><footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("<", "<"),
        (page("<h1>A &amp; B</h1><p>one  two<br>three\n four</p><p>five"), "A & B\none two three four\nfive"),
        (page("<p><b>x<br><p>y</p>"), "x\ny"),
        (page("<ul><li>1<li>2</ul><div class='share-buttons'>s</div><section id=comments><p>c</p></section>"), "1\n2"),
        (page("<header><h2>T</h2></header><p>b&nbsp;c</p><script>var t='</p>'</script>"), "T\nb c"),
        (page("x", "<div class='cookie-notice'>We use cookies</div><div class=sidebar>q</div>"), "x"),
        ("<div><p>no article</p><div class=menu>m</div><p>1 < 2</p><p cla", "no article\n1 < 2"),
        ("<!-- only", ""),
        ("<main><p>m</p><nav>n</nav></main><p>out</p>", "m"),
    ],
)
def test_extract(source, text):
    assert html_extract.extract(source) == text


def test_deep_and_long_pages_keep_their_text():
    assert html_extract.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(html_extract.extract(page("<p>x</p>" * 20000)).split("\n")) == 20000


def test_deep_articles_and_furniture_keep_their_place():
    for n in (10, 300, 20000):
        deep = "<div>" * n + "<nav>menu</nav><article><p>one</p><div>two</div></article><aside>side</aside>" + "</div>" * n
        assert html_extract.extract(deep) == "one\ntwo"
        inner = "<article>" + "<div>" * n + "a<nav>menu</nav><div>b</div><!-- c -->" + "</div>" * n + "<p>rest</p></article>"
        assert html_extract.extract("<div>" + inner + "</div><p>out</p>") == "a\nb\nrest"
    assert html_extract.extract("<p>" + "<button>" + "<div class=nav>" * 20000 + "x" + "</div>" * 20000 + "</button></p>") == ""


def shell(i, body):
    return f"<html><body><div class=top>Welcome all</div><div class=c>{body}</div><div class=b>All rights kept {2000}</div></body></html>"


def test_template_goes_and_slots_stay(spark):
    rows = [(i, f"http://h.example/{i}", shell(i, f"<p>story {i}</p><p>more {i * 7}</p>")) for i in range(12)]
    rows += [(100, "http://few.example/1", shell(1, "<p>few</p>")), (101, None, shell(1, "<p>n</p>")), (102, "http://h.example/x", None), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {}
    for r in html_extract.digests(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[3] == ["story 3\nmore 21"] and got[0] == ["story 0\nmore 0"] * 2
    assert got[100] == ["Welcome all\nfew\nAll rights kept 2000"] and got[101][0].startswith("Welcome") and got[102] == [""]
    assert html_extract.digests(df.limit(0)).count() == 0


def read_pages(spark, rows):
    df = spark.createDataFrame([(i, f"http://{h}.example/{i}", p) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string")
    return [r["text"] for r in html_extract.main_text(df).orderBy("page_id").collect()]


def test_wrappers_come_from_all_pages_of_a_host(spark):
    rows = [(f"five{k}", shell(0, f"<p>story {k} {i}</p>")) for k in range(12) for i in range(5)]
    got = read_pages(spark, rows)
    assert got == [f"story {k} {i}" for k in range(12) for i in range(5)]
    # A hot host with two layouts that differ in their constant texts at one place, and a notice on 70 % of its pages.
    notice = "<section><p>Closed on Monday</p></section>"
    two = [f"<html><body><div>{'Left' if i % 2 else 'Right'} paper</div>{'<ul><li>' if i % 2 else '<table><tr><td>'}item {i}{'</ul>' if i % 2 else '</table>'}{notice if i % 10 < 7 else ''}</body></html>" for i in range(60)]
    assert read_pages(spark, [("hot", p) for p in two]) == [f"item {i}" for i in range(60)]


def test_large_and_deep_pages_have_a_wrapper(spark):
    big = [shell(0, "".join(f"<h2 class=s{k}>part {i} {k}</h2><p class=t{k}>text {i} {k}</p>" for k in range(300))) for i in range(6)]
    deep = [shell(0, "<div>" * 3000 + f"<b>page {i}</b>" + "</div>" * 3000) for i in range(6)]
    got = read_pages(spark, [("big", p) for p in big] + [("deep", p) for p in deep])
    assert not any("Welcome" in t or "All rights" in t for t in got)
    assert got[0].split("\n")[:2] == ["part 0 0", "text 0 0"] and got[6:] == [f"page {i}" for i in range(6)]


def weight_of(a, b, x=0, y=0):
    """Simple tree matching by its textbook recursion."""
    if a.label[x] != b.label[y]:
        return 0
    u, v = a.kids[x], b.kids[y]
    best = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
    for i in range(len(u)):
        for j in range(len(v)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight_of(a, b, u[i], v[j]))
    return 2 + (a.words[x] == b.words[y]) + best[-1][-1]


def test_alignment_is_the_heaviest_match():
    rng = random.Random(5)

    def tree():
        t = html_extract.Tree()
        t.add("#root", "", -1)
        for _ in range(rng.randrange(14)):
            t.add(rng.choice("abc"), rng.choice(["", "x", "y"]), rng.randrange(len(t.label)))
        return t

    for _ in range(300):
        a, b = tree(), tree()
        got = html_extract.align(a, b)
        pairs = [(x, y) for x, y in enumerate(got) if y >= 0]
        assert sum(2 + (a.words[x] == b.words[y]) for x, y in pairs) == weight_of(a, b)
        assert len({y for _, y in pairs}) == len(pairs)
        for x, y in pairs[1:]:
            assert a.label[x] == b.label[y] and got[a.parent[x]] == b.parent[y]
            for z, w in pairs[1:]:  # siblings keep their order
                if a.parent[x] == a.parent[z] and a.kids[a.parent[x]].index(x) < a.kids[a.parent[z]].index(z):
                    assert b.kids[b.parent[y]].index(y) < b.kids[b.parent[w]].index(w)


def test_content_is_chosen_by_alignment_where_names_mislead(spark):
    """No article, no telling names: menus, notices and articles are plain or wrongly named frames."""
    story = lambda i: "".join(f"<p>Sentence {i} {k} of a story that goes on for some words.</p>" for k in range(3 + i % 4))
    plain = [f"<body><div><a href=/{i}>Go {i}</a> <a href=/x{i}>Then {i}</a></div><div><h2>Title {i}</h2>{story(i)}</div><div>Tip {i}</div></body>" for i in range(8)]
    wrong = [f"<body><div class=menu><a href=/{i}>Go {i}</a></div><div class=sidebar>{story(i)}</div><div class=content>Sale {i}</div></body>" for i in range(8)]
    teasers = [f"<body><div>{story(i)}</div><div><article><a href=/{i}>See {i}</a></article><article><a href=/y{i}>Or {i}</a></article></div></body>" for i in range(8)]
    rows = [(h, p) for h, ps in (("plain", plain), ("wrong", wrong), ("teasers", teasers)) for p in ps]
    text = lambda i: "\n".join(f"Sentence {i} {k} of a story that goes on for some words." for k in range(3 + i % 4))
    want = [f"Title {i}\n{text(i)}" for i in range(8)] + [text(i) for i in range(8)] * 2
    assert read_pages(spark, rows) == want
    # Without a wrapper (the only page of a host) names choose, and are misled.
    assert html_extract.extract(wrong[0]) == "Sale 0"
    # Wrappers joined by a shuffle give the same.
    df = spark.createDataFrame([(i, f"http://{h}.example/{i}", p) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string")
    assert [r["text"] for r in html_extract.main_text(df, broadcast_bytes=-1).orderBy("page_id").collect()] == want


def test_comments_and_short_articles_are_not_taken_for_content(spark):
    """Long comments beside a short article: the place is not clear, so names decide."""
    talk = lambda i: "".join(f"<p>Reader {i} {k} writes at length about many things and more.</p>" for k in range(6))
    rows = [("talk", f"<body><article><h1>News {i}</h1><p>Short {i}.</p></article><section class=comments>{talk(i)}</section></body>") for i in range(7)]
    assert read_pages(spark, rows) == [f"News {i}\nShort {i}." for i in range(7)]


def test_wide_pages_align_in_bounded_time():
    many = html_extract.fold(html_extract.parse("<body>" + "".join(f"<div id=a{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}><div>{'<div>x</div>' * 12}</div></div>" for k in range(3000))))
    alternate = html_extract.fold(html_extract.parse("<body>" + "<h2>t</h2><div><p>x</p></div>" * 3000))
    nested = "<div>x</div>"
    for _ in range(4):
        nested = "<div>" + nested * 8 + "</div>"
    deep = html_extract.fold(html_extract.parse(nested))
    for t in (many, alternate, deep):
        assert html_extract.align(t, t) == list(range(len(t.label)))
        assert html_extract.Tree.unpack(t.pack()).label == t.label

