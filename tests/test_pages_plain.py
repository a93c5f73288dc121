"""Pages that one pattern reads, against the parser."""

import random

from airspan.sources import pages


def flat(node):
    return node.tag, node.classes, [p if isinstance(p, str) else flat(p) for p in node.parts]


def test_plain_pages_give_the_parsers_tree_and_only_whole_names_are_raw_text():
    parts = ["<div class='content'>", "</div>", "<TD class=\"a b\">", "</td>", "<tr>", "</tr>", "<br>", "<br/>", "<b/>", "x &amp; y", "<title>", "<titlex>", "</titlex>"]
    draw, plain = random.Random(2), 0
    for _ in range(2000):
        page = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 15)))
        parsed, read = pages._Tree(), pages._Tree()
        parsed.feed(page)
        parsed.close()
        if pages._read_plain(read, page):
            plain += 1
            assert flat(read.root) == flat(parsed.root)
    assert plain > 500
    assert pages._read_plain(pages._Tree(), "<titlex>a</titlex>")
