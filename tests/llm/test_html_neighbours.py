"""op5: which page is compared, what it may delete, and that parts do not matter."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from voxarbor.llm import html_text  # noqa: E402

SCHEMA = "page_id long, url string, html string"


def texts(pages):
    return {r.page_id: r.text for r in html_text.main_text(pages).collect()}


def page(lines, outer="{}"):
    return outer.format("".join(f"<p>{x}</p>" for x in lines))


def test_shared_lines_inside_article_go(spark):
    rows = [(i, f"http://a.org/p/{i}", page([f"own text number {i} of this page", "Share this"], "<article>{}</article>")) for i in range(4)]
    assert texts(spark.createDataFrame(rows, SCHEMA)) == {i: f"own text number {i} of this page" for i in range(4)}


def test_copies_are_no_neighbours(spark):
    body = [f"line {k} of one long article text" for k in range(9)]
    rows = [(i, f"http://a.org/a/{i}", page(["Site", *body, f"v{i}", "Bottom"])) for i in range(5)]  # near copies
    rows += [(9, "http://a.org/a/0", page(["Site", *body, "v0", "Bottom"])), (10, "http://a.org/z/1", page(["Site", "quite another page here", "Bottom"]))]
    got = texts(spark.createDataFrame(rows, SCHEMA))
    assert got == {**{i: "\n\n".join([*body, f"v{i}"]) for i in range(5)}, 9: "\n\n".join([*body, "v0"]), 10: "quite another page here"}


def test_parts_do_not_matter(spark):
    rng = random.Random(3)
    rows = []
    for host in range(12):
        for n in range(rng.choice([1, 2, 3, 30])):
            own = [f"words {rng.randrange(10**9)} of {host}" for _ in range(3)]
            for _ in range(rng.choice([1, 1, 2, 9])):
                rows.append((len(rows), f"http://h{host}.org/{n % 4}/{n}", page([f"Site {host}", *own, "Bottom"])))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = []
        for n in ("1", "7", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(texts(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[0] == got[1] == got[2]
    assert sum("Site" in t for t in got[0].values()) < len(rows) / 4
