"""URL filters and chat formatting, with their SQL; plans without Python."""

import duckdb
import pytest

from siftmill.llm import bloom, chat, urlfilter

URLS = [
    (1, "https://a.net/x"), (2, "http://EXAMPLE.net/en/1?q#f"), (3, "ftp://m.example.com/de/"), (4, "https://x.org/fr/a"), (5, "https://net/"), (6, "https://net"), (7, "https://anet/x"),
    (8, None), (9, ""), (10, "no scheme net/"), (11, "https://example.net/EN/"), (12, "https://a.net:80/x"), (13, "https://a.net/x"), (13, "https://a.net/x"), (14, "x://y://z.net/"), (15, "https://b.net?q=/x"),
]


def pages(spark, rows=URLS):
    return spark.createDataFrame([(i, u, "h", "x", "y", "z") for i, u in rows], "page_id long, url string, html string, host string, rule string, hits string")


def listed(spark, rules=urlfilter.RULES):
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_verdicts(spark):
    got = sorted(map(tuple, urlfilter.judge(pages(spark), listed(spark)).collect()), key=str)
    assert got == sorted(((i, *plain(u, urlfilter.RULES)) for i, u in URLS), key=str)


def test_long_lists(spark):
    rules = [*urlfilter.RULES, *((f"h{i}.net", f"/p{i % 7}", "block") for i in range(400))]
    urls = [(i, f"https://h{i}.net/p{i % 5}/x") for i in range(300)] + URLS
    got = sorted(map(tuple, urlfilter.judge(pages(spark, urls), listed(spark, rules)).collect()), key=str)
    assert got == sorted(((i, *plain(u, rules)) for i, u in urls), key=str)


def test_empty(spark):
    assert urlfilter.judge(pages(spark, []), listed(spark)).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages(spark), listed(spark, [])).collect()} == {"allow"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS key")
    may = bloom.test(bloom.build(keys, "key"))
    assert keys.filter(may(keys["key"])).count() == 5000
    other = spark.range(5000).selectExpr("concat('other', id) AS key")
    assert other.filter(may(other["key"])).count() < 250


def test_the_plan_does_not_grow_with_the_list(spark):
    def size(n):
        rules = spark.createDataFrame([(".".join(["a"] * (1 + i % 9)), "/" + "p" * (i // 9), "block") for i in range(n)], "host string, path string, action string")
        made = urlfilter.judge(pages(spark), rules)
        assert made.count() == pages(spark).count()
        return len(made._jdf.queryExecution().analyzed().toString().split("substr"))

    assert size(300) == size(3)
    assert {r["verdict"] for r in urlfilter.judge(pages(spark), listed(spark).limit(0)).collect()} == {"allow"}


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yes"), (3, 2, "user", "more"), (4, 5, "user", "hi"), (4, 6, "bot", "no"),
    (5, 0, "user", None), (5, 1, "bot", "x"), (6, 0, "user", ""), (7, 0, None, "alone"), (8, 0, "user", "hi"), (8, 1, "bot", "no"), (None, 0, "user", "lost"), (9, 1, "b", "t"), (9, 1, "a", "t"),
]


def turns(spark, rows=TURNS):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos long, h1 string")


def test_chat(spark):
    got = {r["conv_id"]: r["text"] for r in chat.render(turns(spark)).collect()}
    assert set(got) == {3, 4, 5, 6, 7, None, 9}  # 1 and 2 begin 3, 8 repeats 4
    assert got[3] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>bot\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[7] == "<|im_start|>unknown\nalone<|im_end|>\n"
    assert got[9].startswith("<|im_start|>a\n")
    assert chat.render(turns(spark, [])).count() == 0


def test_chat_ties_and_repeated_rows(spark):
    rows = [
        (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, None, "z"), (1, None, "user", "first"), (2, None, "user", "first"), (2, 0, None, "z"), (2, 0, "user", "a"), (2, 0, "user", "b"), (2, 1, "bot", "end"),
        (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "same"), (0, 7, "user", "zero"), (None, 7, "user", "null"), (5, 0, "user", "x" * 200_000), (6, 0, "user", None), (6, 0, "user", ""),
    ]
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.render(turns(spark, rows)).collect()}
    assert set(got) == {2, 3, 0, None, 5, 6}  # 1 begins 2, 4 begins 3
    assert got[2][1] == "".join(chat.TURN % x for x in [("user", "first"), ("unknown", "z"), ("user", "a"), ("user", "b"), ("bot", "end")])
    assert got[3][0] == 2 and got[6][0] == 2 and len(got[5][1]) > 200_000 and got[None][1] == chat.TURN % ("user", "null")


@pytest.mark.parametrize("which", ["urls", "chat"])
def test_sql(spark, which):
    db = duckdb.connect()
    if which == "urls":
        pages_ = pages(spark).toPandas()
        db.register("pages", pages_)
        got, sql = urlfilter.judge(pages(spark), listed(spark)), urlfilter.SQL
    else:
        known = turns(spark, [r for r in TURNS if r[0] is not None])
        conversations = known.toPandas()
        db.register("conversations", conversations)
        got, sql = chat.render(known), chat.SQL
    columns = got.columns
    want = [tuple(None if v != v else v for v in r) for r in db.sql(sql).df()[columns].itertuples(index=False)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_python_in_the_plans(spark):
    for frame in (urlfilter.judge(pages(spark), listed(spark)), chat.render(turns(spark))):
        shown = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(w in shown for w in ("Python", "Pandas", "MapInArrow", "ArrowEval", "CartesianProduct"))
