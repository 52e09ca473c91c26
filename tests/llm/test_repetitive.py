"""Inputs that repeat themselves: whole results in bounded time and memory, the same as on the plain way."""

import random

from strandlake.llm import decontaminate, html_extract
from strandlake.llm._common import Rolling


def test_repetitive_texts_meet_repetitive_items():
    index, roll, text = decontaminate.Index([(1, "na " * 1200)]), Rolling(), decontaminate.plain("na " * 6000)
    found = index.matches(text, roll)
    item = index.items[0][1]
    assert all(text[s:e] == item if cost == 0 else 0 < cost <= decontaminate.budget(len(item)) for _, s, e, cost in found)
    assert len([s for _, s, _, cost in found if cost == 0]) > 50


def test_regions_do_not_depend_on_how_pairs_are_made(monkeypatch):
    rnd, roll = random.Random(4), Rolling()
    for _ in range(40):
        items = [(k, " ".join(rnd.choice(["na", "ba", "nan"]) for _ in range(rnd.randint(5, 120)))) for k in range(5)]
        text = " ".join(rnd.choice(["na", "ba", "nan"]) for _ in range(rnd.randint(5, 600))) + " " + items[0][1][:-2] + "x"
        index, found = decontaminate.Index(items), []
        for most in (1 << 19, 500, 8):
            monkeypatch.setattr(decontaminate, "PAIRS", most)
            found.append(sorted(index.regions(text, roll)))
        assert found[0] == found[1] == found[2]
        # the lemma's count, pair by pair
        plain = [(n, t) for n, (_, t) in enumerate(index.items)]
        wanted, q = set(), decontaminate.Q
        for n, item in plain:
            e, bands = decontaminate.budget(len(item)), {}
            for i in range(len(item) - q + 1):
                for j in range(len(text) - q + 1):
                    if item[i : i + q] == text[j : j + q]:
                        for shift in (0, 1):
                            bands.setdefault((shift, (j - i + shift * (e + 1)) // (2 * e + 1)), []).append(j - i)
            wanted |= {(n, min(d), max(d)) for d in bands.values() if len(d) >= len(item) + 1 - q - q * e}
        assert set(found[0]) == wanted
        if len(wanted) > 3:
            break


def _skeleton(html):
    return html_extract.Skeleton.of(html_extract.Tree.of(html))[0]


def test_pages_of_many_unlike_siblings():
    def page(n, mark):
        return _skeleton("<article><dl>" + "".join(f"<dt>t{i} {mark}</dt><dd>d<b>{mark}</b></dd>" for i in range(n)) + "</dl></article>")

    assert len(html_extract.match(page(2000, 1), page(2000, 2))) == 3 + 3 * 2000
    assert len(html_extract.match(page(2000, 1), page(3, 2))) == 3 + 3 * 3


def test_wide_and_narrow_alignments_agree(monkeypatch):
    rnd = random.Random(8)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}</{t}>" for t in rnd.choices(["b", "i", "u", "div"], k=rnd.randint(0, 6))) if depth else ""

    for _ in range(60):
        a, b = _skeleton(tree(4)), _skeleton(tree(4))
        narrow = html_extract.match(a, b)
        with monkeypatch.context() as m:
            m.setattr(html_extract, "NARROW", 0)
            assert html_extract.match(a, b) == narrow


def test_a_title_is_no_text_without_a_head():
    root = html_extract.Tree.of("<title>t</title><p>b")
    assert html_extract.main_text([root], set()) == "b"
