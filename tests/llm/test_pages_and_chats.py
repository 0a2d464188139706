"""op2 and op6: exact round trips, and pages of many shapes."""

import hashlib
import random

import pytest

from tephra.llm import chat, html

TURNS = "conv_id long, turn long, role string, text string, part long, loss string"


def conversations():
    rng = random.Random(1)
    pieces = [
        "<|im_end|>", "<|im_start|>", "assistant", "<", "<\\", "<\\|", "<\\\\", "|>", "\n", "é", "<|", "n", "<\\n",
        "words "
    ]
    out = []
    for c in range(40):
        for k in range(rng.randrange(1, 6)):
            out.append(
                (
                    c, k, rng.choice(["user", "assistant", "system", "odd\nrole<|"]),
                    "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12)))
                )
            )
    out += [
        (50, 0, None, None), (50, None, "assistant", "first"), (51, 1, "user", "b"), (51, 1, "user", "a"),
        (51, 1, "user", "a"), (None, 0, "assistant", "x"), (None, 1, "user", "y")
    ]
    out += [(60, k, "assistant", "long " * 50) for k in range(30)]
    rng.shuffle(out)
    return [(*r, 1, "clash") for r in out]


@pytest.mark.parametrize("part_bytes", [1 << 20, 600])
def test_chats_round_trip(spark, part_bytes):
    rows = conversations()
    formatted = chat.format_chats(spark.createDataFrame(rows, TURNS), part_bytes=part_bytes)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    low = lambda x: (x is not None, x if x is not None else "")
    for conv in {r[0] for r in rows}:
        turns = sorted(
            (r for r in rows if r[0] == conv), key=lambda r: ((r[1] is not None, r[1] or 0), low(r[2]), low(r[3]))
        )
        said = [t[3] or "" for t in turns if t[2] == "assistant"]
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
    parts = formatted.collect()
    assert len(got) == len({r[0] for r in rows}) and sum(p.n_turns for p in parts) == len(rows)
    assert sum(r.formatted_chars for r in got.values()) == sum(len(p.text) for p in parts)
    assert all(p.text.count("<|") == 2 * p.n_turns for p in parts)
    assert part_bytes > 1000 or max(p.part for p in parts) > 2
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


def test_long_turns_go_in_slices(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE_BYTES", 3000)
    rows = [(1, k, "assistant", "<|" * 700 + "é" * k, 0, "") for k in range(12)] + [(2, 0, "user", "x" * 50_000, 0, "")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, TURNS))).collect()}
    assert (got[1].n_turns, got[1].loss_chars) == (12, sum(len(r[3]) for r in rows[:12])) and got[2].n_turns == 1
    assert got[1].loss_sha256 == hashlib.sha256("".join(r[3] for r in rows[:12]).encode()).hexdigest()


PAGES = {
    "": "", None: "", "plain words": "plain words", "<p>one<p>two": "one\n\ntwo",
    "<body><nav>a, b. c</nav><article><h1>T&eacute;</h1><p>x <b>y</b>\n  z<br>w</p></article><footer>f</footer></body>": "Té\n\nx y z w",
    "<article><header><h1>Title</h1></header><p>Text, here.</p><aside>no</aside><div class='ad'>no</div><form>no<input></form><ul><li>a<li>b</ul></article><section class='comments'><p>No, really. Great, great.</p></section>": "Title\n\nText, here.\n\na\n\nb",
    "<article><p>kept</p><script>var a = '</p><p>no';</script><style>p{}</style><!-- <p>no</p> --><p>also&amp;&#33;</p></article>": "kept\n\nalso&!",
    "<div id=cookie-banner>We use cookies, sorry.</div><main><p>Only this.</p></main><div class=sidebar>no</div>": "Only this.",
    "<div class='page'><div class='content'><h2>H</h2><p>Long para, with commas, and stops. And more, too.</p><p>s</p></div><div class='menu'>no</div></div>": "H\n\nLong para, with commas, and stops. And more, too.\n\ns",
    "<nav>only a menu</nav><footer>and a footer</footer>": "", "<article><p>open <i>tag": "open tag",
    "<article><table><tr><td>a<td>b<tr><td>c</table></article>": "a\n\nb\n\nc",
    "<article>a &lt;p&gt; b &nbsp; c</article>": "a <p> b c",
    "<article><p>x</article><script>never closed <p>no</p>": "x", "<article><p title='a > b'>q</p></article>": "q",
}


def test_pages(spark):
    rows = [(k, f"u{k}", p, "clash", 3) for k, p in enumerate(PAGES)] + [
        (0, "u0", "<p>again", "clash", 3), (None, None, "<p>null id</p>", None, None)
    ]
    got = html.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    ).collect()
    by_url = {r.url: r for r in got if r.url != "u0"}
    for k, (page, want) in enumerate(PAGES.items()):
        if k:
            assert by_url[f"u{k}"].text == want, page
            assert by_url[f"u{k}"].n_chars == len(want)
    assert sorted(r.text for r in got if r.url == "u0") == ["", "again"] and by_url[None].text == "null id"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_nothing_of_a_long_article_is_lost():
    rng = random.Random(3)
    blocks = [
        " ".join(rng.choice(["word", "and", "so.", "then,"]) for _ in range(rng.randrange(1, 60))) for _ in range(3000)
    ]
    page = "<html><body><nav><a href=x>menu</a></nav><article>" + "".join(
        f"<p>{b}</p>" for b in blocks
    ) + "</article></body></html>"
    assert html.main_text(page) == "\n\n".join(blocks)


@pytest.mark.parametrize("paragraphs", [3, 8, 60, 1500])
@pytest.mark.parametrize("where", ["before", "after", "within", "in main"])
def test_the_selection_decides_beside_an_article(paragraphs, where):
    """A teaser in an article element does not stand for the page; the body in a plain element does."""
    rng = random.Random(paragraphs)
    body = [
        " ".join(rng.choice(["word", "and", "so.", "then,"]) for _ in range(rng.randrange(40, 80)))
        for _ in range(paragraphs)
    ]
    text = "".join(f"<p>{b}</p>" for b in body)
    card = "<article><h3>Other story</h3><p>Read it</p></article>"
    page = {
        "before": f"{card}<div>{text}</div>", "after": f"<div>{text}</div>{card}", "within": f"<div>{card}{text}</div>",
        "in main": f"<main><h1>Head</h1>{card}<div>{text}</div></main>"
    }[where]
    assert html.main_text(f"<html><body>{page}</body></html>") == "\n\n".join(
        [*(["Head"] if where == "in main" else []), *body]
    )


def test_an_article_keeps_its_headings_and_short_parts():
    long = "A long paragraph, with commas, and stops. And more of it, too. " * 5
    page = f"<article><header><h1>T</h1></header><section><p>{long}</p><h2>s</h2><p>{long}</p><ul><li>x</ul></section></article><div><article><h3>Card</h3></article></div>"
    assert html.main_text(page) == "\n\n".join(["T", long.strip(), "s", long.strip(), "x"])


def test_the_selection_by_brute_force():
    """Ratios, smoothing, fusion and threshold from their plain statement, on pages of random shape."""
    rng = random.Random(9)
    for _ in range(60):
        page = ""
        for _ in range(rng.randrange(1, 12)):
            tag = rng.choice(["div", "section", "article", "p", "ul", "h2"])
            inner = rng.choice(["p", "li", "span", "div"])
            text = " ".join(rng.choice(["word", "and", "so.", "then,", "x!"]) for _ in range(rng.randrange(1, 30)))
            page += f"<{tag}><{inner}>{text}</{inner}></{tag}>"
        blocks = html.blocks_of(page)
        per_path = {}
        for _, path, text in blocks:
            per_path.setdefault(path, []).append(text)
        ratio = {
            p: (sum(map(len, x)) / len(x), sum(c in ".,;:!?…、。，！？" for t in x for c in t) / len(x) + 0.1)
            for p, x in per_path.items()
        }
        groups, fused = [], []
        for b in blocks:
            if not groups or groups[-1][-1][0].piece is not b[0].piece:
                groups.append([])
            groups[-1].append(b)
        for g in groups:
            for k in range(len(g)):
                near = [g[min(max(k + d, 0), len(g) - 1)][1] for d in (-2, -1, 0, 1, 2)]
                smooth = [sum(w * ratio[p][i] for w, p in zip((1, 2, 3, 2, 1), near)) / 9 for i in (0, 1)]
                fused.append((smooth[0] * smooth[1] * ratio[g[k][1]][0] * ratio[g[k][1]][1]) ** 0.5)
        least = html.THRESHOLD * sum(f * len(b[2]) for f, b in zip(fused, blocks)) / sum(len(b[2]) for b in blocks)
        best = {p: max(f for f, b in zip(fused, blocks) if b[1] == p) for p in per_path}
        close = any(abs(x - least) < 1e-9 for x in best.values())
        assert close or html.selected(blocks) == [k for k, b in enumerate(blocks) if best[b[1]] >= least]


def test_pages_without_names_go_by_their_ratios():
    """No article, role, class or id anywhere: menus, an advert and a footer go, the paragraphs stay."""
    rng = random.Random(8)
    right = wrong = lost = 0
    for _ in range(40):
        body = [
            " ".join(rng.choice(["word", "and", "so.", "then,", "longer"]) for _ in range(rng.randrange(30, 90)))
            for _ in range(rng.randrange(3, 20))
        ]
        menu = "<div><ul>" + "".join(f"<li><a href=/{k}>item {k}</a></li>" for k in range(6)) + "</ul></div>"
        page = f"<body>{menu}<div>Buy it now.</div><div>{''.join(f'<p>{b}</p>' for b in body)}</div><div>(c) someone</div></body>"
        got = html.main_text(page).split("\n\n")
        right += sum(g in body for g in got)
        wrong += sum(g not in body for g in got)
        lost += sum(b not in got for b in body)
    assert right / (right + wrong) > 0.95 and right / (right + lost) > 0.95


@pytest.mark.parametrize(
    "piece, times",
    [
        ('<p "x ', 170_000), ("<p '> ' x", 110_000), ("<div>a ", 140_000), ("<div></x>", 110_000), ("<b>x<p>", 140_000),
        ('<a b="x\' > ', 90_000), ("< ", 500_000), ("<li>a<div>", 100_000), ('<script "', 110_000),
        ("<article>a", 100_000)
    ]
)
def test_long_broken_pages_take_linear_time(piece, times):
    import time

    began = time.process_time()
    html.main_text(piece * times)
    assert time.process_time() - began < 15  # about a second; quadratic code takes minutes


def test_broken_quotes_end_tags_nevertheless():
    page = "<p a='x>" * 41 + "text</p>"
    assert html.main_text(page).endswith("text")
