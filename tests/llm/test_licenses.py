import random
import textwrap

from strideframe.llm.licenses import SHORT, TEMPLATES, Scanner, align, ends, scan_licenses
from strideframe.llm.queries import op7_license_scan


def plain_align(words, template):
    """Word edit distance with free ends in ``words``."""
    cost = [0] * (len(words) + 1)
    for i, w in enumerate(template, 1):
        new = [i]
        for j, x in enumerate(words, 1):
            new.append(min(cost[j - 1] + (x != w), cost[j] + 1, new[-1] + 1))
        cost = new
    return min(cost)


def test_align_against_plain():
    import random

    rng = random.Random(0)
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 14))]
        template = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        assert align(words, template)[0] == plain_align(words, template)


def test_every_template_is_found(spark):
    rows = [(i, f"Some words before.\n{text}\nSome after.") for i, text in enumerate(TEMPLATES.values())]
    rows += [(100 + i, "Word " * 700 + text + " tail" * 500) for i, text in enumerate(TEMPLATES.values())]
    found = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.differences == 0}
    for i, name in enumerate(TEMPLATES):
        assert found[i].license == name and found[100 + i].license == name


def test_changed_wording_and_clean_text(spark):
    changed = TEMPLATES["MIT"].replace("free of charge", "without any charge")
    rows = [(1, changed), (2, "They renewed their fishing license and asked for permission."), (3, "a license " * 3000)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "MIT")] and got[0].differences > 0


def test_odd_rows(odd_docs, no_docs):
    got = scan_licenses(odd_docs).collect()
    assert [(r.doc_id, r.license, r.start) for r in got] == [(10, "Apache-2.0-short", 0)]
    assert scan_licenses(no_docs).count() == 0


def test_query_against_search(spark, sf_dir):
    # The planted notices are whole lines: plain string search finds the same documents.
    got = {(r.doc_id, r.license) for r in op7_license_scan(spark, sf_dir).collect() if r.differences == 0}
    want = {(r.doc_id, n) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for n, t in TEMPLATES.items() if t in r.text}
    assert want <= got and {d for d, _ in want} == {d for d, _ in got}


def test_every_template_is_found_however_it_is_wrapped(spark):
    names, widths = list(TEMPLATES), range(40, 81, 4)
    rows = [(1000 * i + w, "Some words before.\n\n" + textwrap.fill(TEMPLATES[n], w, break_long_words=False, break_on_hyphens=False) + "\n\nSome after.") for i, n in enumerate(names) for w in widths]
    got = {(r.doc_id, r.license) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.differences == 0}
    assert got == {(1000 * i + w, n) for i, n in enumerate(names) for w in widths}


def test_lists_of_notices_are_found_whole(spark):
    credits = [n for n in TEMPLATES if n != "CC-BY-4.0-short"]
    texts = [
        [n for n in ("Apache-2.0", "GPL-3.0", "CC-BY-4.0-short", "MIT")],
        ["MIT-short", "MIT-short"],
        ["CC-BY-4.0-short"] * 40,
        ["MIT"] * 3,
        credits * 30,
    ]
    rows = [(i, "\n".join(TEMPLATES[n] for n in names)) for i, names in enumerate(texts)]
    got = {}
    for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "start").collect():
        assert r.differences == 0
        got.setdefault(r.doc_id, []).append(r.license)
    assert got == dict(enumerate(texts))


def test_notices_against_cutting_out_one_at_a_time():
    rng = random.Random(3)
    short = {"a": "license x y z u v w", "b": "x y license z u v w q", "c": "license license x y z y x"}
    scanner = Scanner(short)

    def plain(words, offset):
        best = []
        for name, text in short.items():
            t = text.split()
            cost, start = ends(words, t)
            best += [(int(c) / len(t), -len(t), offset + int(s), offset + e, name) for e, (c, s) in enumerate(zip(cost, start, strict=True)) if c <= 0.15 * len(t) and s < e and "license" in words[s:e]]
        if not best:
            return []
        _, _, first, end, name = best = min(best)
        return plain(words[: first - offset], offset) + [(name, first, end)] + plain(words[end - offset :], end)

    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 9)):
            some = rng.choice(list(short.values())).split()
            if rng.random() < 0.6:
                some[rng.randrange(len(some))] = rng.choice(["x", "license", "other"])
            words += some[rng.randrange(2) :] + ["pad"] * rng.randrange(2)
        text = " ".join(words)
        at = {sum(len(w) + 1 for w in words[:i]): i for i in range(len(words))}
        got = [(x["license"], at[x["start"]], at[x["start"]] + len(text[x["start"] : x["end"]].split())) for x in scanner.scan(text)]
        assert got == plain(words, 0)


def test_a_long_notice_of_ones_own(spark):
    words = [f"clause{i}" for i in range(280)]
    own = {"own": " ".join(words), "with": "You may ask for permission " + " ".join(words[:90])}
    rows = [(1, own["own"]), (2, "Some text. " * 50 + own["with"] + " more text" * 80), (3, "no notice"), (4, " ".join(words[:240] + ["x"] * 20 + words[260:]))]
    got = {(r.doc_id, r.license, r.differences) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=own).collect()}
    assert got == {(1, "own", 0), (2, "with", 0), (4, "own", 20)}


def test_compression_ranks_the_right_template_first_and_leaves_no_match_out():
    rng = random.Random(8)
    scanner = Scanner(TEMPLATES)
    prose = [f"{a}{b}" for a in ("re", "con", "mar", "sol", "tin") for b in ("ta", "den", "vel", "ior", "am", "es")]
    for name, (words, _) in scanner.templates.items():
        for _ in range(4 if len(words) > 60 else 40):
            changed = list(words)
            for at in rng.sample(range(len(words)), int(0.15 * len(words))):
                changed[at] = rng.choice(prose)
            block = rng.choices(prose, k=rng.randrange(300)) + changed + rng.choices(prose, k=rng.randrange(300))
            ranked = scanner.savings(block, list(scanner.templates))
            assert ranked[name] > 0 or len(words) < SHORT
            if len(words) < 30:
                continue
            # What saves more than a long notice shares its words: no template of other wording stands above it.
            above = list(ranked)[: list(ranked).index(name)]
            assert all(len(set(words) & set(scanner.templates[n][0])) > 0.6 * min(len(set(words)), len(set(scanner.templates[n][0]))) for n in above), (name, above)
