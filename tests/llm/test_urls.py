import random

from ossicle.llm import urls


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    best = (None, None)
    for text, action in rules:
        name, rest = text.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and len(text) > len(best[0] or ""):
            best = (text, action)
    return host, path, *best


URLS = [
    None, "", "no scheme", "http://", "http://A.B.Example.COM/en/7x?q#f", "https://example.com/en/", "https://notexample.com/en/7", "x://com/en/", "https://É.example.net/DE/8", "https://www.example.net/de/81#/x",
    "https://www.example.net/de/7?u=http://b.org/es/", "http://org/es/1", "http://org?es/1", "http://a#b/c", "a://b://c/d", "http://h.org/x\ny/z?", "http://h.net//de/", "/no://host/p",
]


def test_parts_and_rules(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[4], "n"), (4, URLS[4], "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, None), (99, 1)], "doc_id long, bad int")
    got = sorted((tuple(r)[:4] for r in urls.judge(pages, labels).collect()), key=str)
    assert got == sorted(((d, *brute(u, urls.RULES)[:3]) for d, u, _ in rows), key=str)
    verdicts = {r.page_id: r.verdict for r in urls.judge(pages, labels).collect()}
    for i, u in enumerate(URLS):
        assert verdicts[i] == (brute(u, urls.RULES)[3] or "allow")
    assert urls.judge(pages.limit(0), labels).collect() == []


def test_templates_are_learnt(spark):
    rows, marks = [], []
    for i in range(400):  # slugs under /ads/ are bad, under /news/ good; one host has no labels
        for j, (host, kind) in enumerate((("a.org", "ads"), ("a.org", "news"), ("b.org", "ads"))):
            page = 10 * i + j
            rows.append((page, f"http://{host}/{kind}/s{chr(97 + i % 26)}{chr(97 + i % 25)}/{i}"))
            if host == "a.org" and i % 2:
                marks.append((page, int(kind == "ads")))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "id long, bad int"), []).toPandas()
    a = got[got.host == "a.org"]
    assert set(a.template) == {"/ads/*/#", "/news/*/#"}
    assert (a[a.template.str.startswith("/ads")].verdict == "block").all() and (a[a.template.str.startswith("/news")].verdict == "allow").all()


def test_similar_branches_share_their_evidence(spark):
    rows = [(i, f"http://h.org/{'abcd'[i % 4]}") for i in range(40)]
    marks = [(i, 1) for i in range(40) if i % 4 != 3][:24]  # d has no label, a to c are bad alike
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "id long, bad int"), []).toPandas()
    assert got.groupby("template").purity.nunique().max() == 1
    assert got[got.template.isin(["/a", "/b", "/c"])].purity.nunique() == 1


def verdicts(spark, counts, **more):
    """The verdicts of one host's paths from {path: (labelled, bad)}; every path has an unlabelled page, too."""
    rows, marks = [], []
    for path, (n, bad) in counts.items():
        for i in range(n + 1):
            rows.append((len(rows), f"http://h.org{path}"))
            if i < n:
                marks.append((len(rows) - 1, int(i < bad)))
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "id long, bad int"), [], **more)
    out = {r.path: (r.verdict, r.purity) for r in got.collect()}
    assert set(out) == set(counts)
    return out


def brute_purity(counts, few=8, prior=8.0, z=1.96):
    apart = lambda l, b, m, c: abs((b + 0.5) / (l + 1) - (c + 0.5) / (m + 1)) > z * ((lambda p: p * (1 - p))((b + c + 0.5) / (l + m + 1)) * (1 / (l + 1) + 1 / (m + 1))) ** 0.5  # noqa: E731, E741
    share = lambda l, b: (b + 0.5) / (l + 1)  # noqa: E731, E741
    hl, hb = (sum(x[i] for x in counts.values()) for i in (0, 1))
    host = (hb + prior * hb / max(hl, 1)) / (hl + prior)
    branches, out = [], {}
    for _, path in sorted((share(n, b), p) for p, (n, b) in counts.items() if n >= few):
        n, b = counts[path]
        if branches and not apart(branches[-1][0], branches[-1][1], n, b):
            branches[-1] = [branches[-1][0] + n, branches[-1][1] + b, branches[-1][2] + [path]]
        else:
            branches.append([n, b, [path]])
    for n, b, paths in branches:
        out |= {p: (b + prior * host) / (n + prior) for p in paths}
    for path, (n, b) in counts.items():
        if n < few:
            near = min(((abs(share(x, y) - share(n, b)), x, y) for x, y, _ in branches if n and not apart(x, y, n, b)), default=(0, 0, 0))
            out[path] = (near[2] + b + prior * host) / (near[1] + n + prior)
    return out


def test_sparse_siblings_bridge_no_branches(spark):
    got = verdicts(spark, {"/news": (100, 10), "/x": (0, 0), "/y": (1, 1), "/v": (2, 0), "/ads": (100, 89)})
    assert {p: v for p, (v, _) in got.items()} == {"/news": "allow", "/x": "allow", "/y": "block", "/v": "allow", "/ads": "block"}


def test_purity_matches_brute_force(spark):
    rng = random.Random(9)
    counts = {f"/p{chr(97 + i)}": (n, rng.randrange(n + 1) if n else 0) for i, n in enumerate((0, 1, 2, 5, 7, 8, 20, 60, 60, 90, 11, 9, 300))}
    got, want = verdicts(spark, counts), brute_purity(counts)
    assert all(abs(got[p][1] - want[p]) < 1e-9 and got[p][0] == ("block" if want[p] >= 0.5 else "allow") for p in counts)
