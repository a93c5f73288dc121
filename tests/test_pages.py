"""Parsing of station pages."""

import random

from airspan.sources import pages as module
from airspan.sources.pages import parse_pages, station_of_pages

TABLE = """<div class="leaflet-popup-content"><table><tr><td><b>Estación:</b></td><td> San  Borja </td></tr></table>
<div class="content x"><div class="content-1"><table><tbody><tr><td>no</td><td>no</td></tr></tbody></table></div>
<div class="content-2"><table><thead><tr><td>Fecha</td></tr></thead><tbody>{rows}</tbody></table></div></div></div>"""


def pages(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def rows(df):
    return [tuple(r)[1:] for r in df.orderBy("page_id", "row_no").collect()]


def test_rows_by_position(spark):
    html = TABLE.format(rows="""<tr><td>01/01/2024</td><td>10:00</td><td>1,929.70</td><td>15,32</td><td>a,b</td></tr>
        <tr><td></td><td>&nbsp;</td></tr><tr></tr>
        <tr><td>01/01/2024<br>x</td><td>09:00</td><td>1</td><td>2</td><td>3</td><td>4</td><td>5</td><td>6</td><td>7</td></tr>""")
    assert rows(parse_pages(pages(spark, html))) == [
        (0, "San  Borja", "01/01/2024", "10:00", "1.929.70", "15.32", "a,b", "", "", ""),
        (3, "San  Borja", "01/01/2024 x", "09:00", "1", "2", "3", "4", "5", "6")]
    assert rows(parse_pages(pages(spark, html), first_only=True)) == [
        (0, "San  Borja", "01/01/2024", "10:00", "1,929.70", "15.32", "a,b", "", "", "")]


def test_first_row_needs_two_cells(spark):
    html = TABLE.format(rows="<tr><td>only</td></tr><tr><td>a</td><td>b</td></tr>")
    assert rows(parse_pages(pages(spark, html), first_only=True)) == []
    assert [r[0] for r in rows(parse_pages(pages(spark, html)))] == [0, 1]


def test_pages_without_table_or_label(spark):
    odd = ["", None, "<p>content</p>", "<div class=content><p>x</p></div><table>", "<TABLE><tbody><tr><td>1</td></tr>",
           "<b>Estación: </b>", "<div class='content'><table><tr><td>no body</td></tr></table></div>"]
    assert rows(parse_pages(pages(spark, *odd))) == []
    assert [r["station"] for r in station_of_pages(pages(spark, *odd)).orderBy("page_id").collect()] == [""] * len(odd)


def test_content_without_second_part_and_char_references(spark):
    html = ("<table><tr><td><strong>Estaci&oacute;n:</strong></td><td>Ate</td></tr></table>"
            "<div class='content'><TABLE><TBODY><tr><td>d</td><td>t</td></tr></TBODY></TABLE></div>")
    assert rows(parse_pages(pages(spark, html))) == [(0, "Ate", "d", "t", "", "", "", "", "", "")]


def shape(node):
    return [(p.tag, p.classes, shape(p)) if isinstance(p, module._Node) else p for p in node.parts]


def merged(parts):
    """Neighbouring texts as one: the parser may give a text in several parts."""
    out = []
    for p in parts:
        p = (p[0], p[1], merged(p[2])) if isinstance(p, tuple) else p
        if isinstance(p, str) and out and isinstance(out[-1], str):
            out[-1] += p
        else:
            out.append(p)
    return out


def test_plain_pages_are_read_as_the_parser_reads_them():
    rng = random.Random(1)
    bits = ["<div class='a b'>", "</div>", '<td CLASS="x" title="a class=y">', "</TD>", "text & more", " &nbsp;&eacute; ", "<br>", "<br/>",
            "<b>", "</b>", "<p class=q>", "<tr >", "</tr >", "\n", "a > b", "<img src=x.png>", "<i/>", "<td class>", "&amp", "</x>",
            "<!-- c -->", "<script>a<b</script>", "<a href='x>y'>", "< d", "<td\r>", "<style>", "&#233;", "</", "<title>x<b></title>"]
    plain = 0
    for _ in range(3000):
        page = "".join(rng.choice(bits[: 21 if rng.random() < 0.7 else len(bits)]) for _ in range(rng.randrange(0, 12)))
        fast, slow = module._Tree(), module._Tree()
        slow.feed(page)
        slow.close()
        if module._read_plain(fast, page):
            plain += 1
            assert merged(shape(fast.root)) == merged(shape(slow.root)), page
    assert plain > 1500
