from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sonde.llm import line_dedup as L


def brute(rows, ratio, least):
    clean = lambda t: [x for x in (" ".join(p for p in line.replace("\t", " ").replace("\r", " ").replace("\f", " ").split(" ") if p) for line in (t or "").split("\n")) if x]
    pages, n = Counter(h or "" for _, h, _ in rows), defaultdict(Counter)
    for _, h, t in rows:
        n[h or ""].update(set(clean(t)))
    out = []
    for i, h, t in rows:
        h = h or ""
        lines = clean(t)
        kept = [x for x in lines if not (pages[h] >= least and n[h][x] > 1 and n[h][x] > ratio * pages[h])]
        out.append((i, h, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def rows():
    out = [(i, f"h{i % 3}", f"menu {i % 3}\n\n unique {i}\t line \nmenu {i % 3}\nshare {i % 5}\n{'foot' if i % 4 else 'end'}") for i in range(60)]
    return out + [(100, "small", "a\nb"), (101, "small", "a\nb"), (102, None, None), (103, None, ""), (104, "h0", "menu 0"), (104, "h0", "menu 0"), (None, "h1", "x\n" * 50000 + "menu 1"), (105, "h2", " \n\t\n")]


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, "k", ["z"]) for r in rows()], "page_id long, host string, text string, line string, bad array<string>")
    for ratio, least in ((0.3, 5), (0.1, 2), (1.0, 1), (0.0, 1)):
        got = sorted((tuple(r) for r in L.drop_boilerplate(df, ratio=ratio, least_pages=least).collect()), key=str)
        assert got == brute(rows(), ratio, least)
    assert L.drop_boilerplate(df.limit(0)).count() == 0


def test_hosts_and_page_lines(spark):
    df = spark.createDataFrame([("HTTPS://A.example.com:80/x?y", "<p>One <b>two</b></p><script>if(a<b)</script><DIV class='x'>three<!-- <p>no --><br/>four</DIV>")], "u string, h string")
    r = df.select(L.host_of(F.col("u")).alias("host"), L.page_lines(F.col("h")).alias("t")).first()
    assert r.host == "a.example.com:80" and [x for x in r.t.split("\n") if x] == ["One two", "three", "four"]
    assert spark.createDataFrame([("no url",), (None,)], "u string").select(L.host_of(F.col("u"))).collect() == [("",), ("",)]
