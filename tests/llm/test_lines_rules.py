"""Quality rules, line dedup, secret scans and resharding against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from lakeforge.llm import entries, linededup, quality, resharding, secrets
from lakeforge.llm.common import Workspace, table


def texts(spark, sf):
    return [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]


def slow_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def check_quality(rows, docs):
    assert Counter((r.doc_id, *slow_quality(r.text)) for r in docs) == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)


def test_quality_matches_brute_force(spark, sf, odd_docs, no_docs):
    docs = table(spark, sf, "documents")
    check_quality(entries.op1_quality_rules(spark, sf).collect(), docs.collect())
    check_quality(quality.score(odd_docs).collect(), odd_docs.collect())
    assert quality.score(no_docs).count() == 0


def test_quality_cleans_line_first(spark):
    prose = "\n".join(f"Plain w{i} stand{i} here{i} and nothing{i} else is fine." for i in range(9))
    rows = [(1, prose + "\nAll rights reserved.\nHome | News | Shop | Help"), (2, "### $$$ a %%%\n" * 30 + " ".join(f"q{i}" for i in range(30)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    assert got[1].kept and got[1].n_lost_lines == 2 and got[1].cleaned.decode() == prose
    assert not got[2].kept
    assert [r.text for r in quality.clean(docs.withColumn("n_chars", docs.doc_id)).collect()] == [prose]


def slow_bad(line):
    """Whether a line is bad, by regular expressions on characters."""
    low = line.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}))
    words, visible = re.findall(r"[^\x20\x09-\x0D]+", low), re.sub(r"[\x20\x09-\x0D]", "", line)
    loud = re.findall(r"[!?]{2,}", line)
    marks = len(re.findall(r"[#*$%&<>=_~^]", line)) + (len("".join(loud)) if len(loud) >= 3 else 0)
    bars = len(re.findall("[|»›•·→]", line))
    menu = sum(w.strip(".,:;!?|") in quality.MENU for w in words)
    return 100 * marks > 10 * len(visible) or (len(words) >= 8 and not re.search("[.!?:;…。！？]", line)) or (bars >= 3 and 4 * bars >= len(words)) or (len(words) <= 12 and menu >= 2 and 2 * menu >= len(words)) or any(p in low for p in quality.PHRASES)


def test_quality_verdicts_match_brute_force(spark, sf, odd_docs):
    """Lines that go, words lost, verdict and cleaned text, by other means than the operator's."""
    for docs in (table(spark, sf, "documents"), odd_docs):
        want = Counter()
        for d in docs.collect():
            text = d.text or ""
            lines = text.split("\n")
            full = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
            bad = [x for x in full if slow_bad(x)]
            lost, (n, *_, failed) = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in bad), slow_quality(text)
            want[d.doc_id, lost, len(bad), not failed and 2 * lost <= n, "\n".join(x for x in lines if x not in bad)] += 1
        assert Counter((r.doc_id, r.n_lost_words, r.n_lost_lines, r.kept, r.cleaned.decode()) for r in quality.score(docs).collect()) == want


def test_quality_judges_lines():
    for line in ("Home | News | Shop | Help", "Startseite » Kontakt » Impressum » Suche", "Accueil, Connexion, Aide", "Inicio Contacto Ayuda", "Alle Rechte vorbehalten, 2020.", "Tous droits réservés.",
                 "WHAT!! A!! DEAL!! TODAY!!", "one two three four five six seven eight", "### $$$ sale %%%"):
        assert quality.bad_line(line.encode()) and slow_bad(line), line
    for line in ("Really?!", "Short heading", "We went home.", "He asked: what next, and who will contact them about it?", "a | b", "Profit rose by 3% to $4 billion, they said."):
        assert not quality.bad_line(line.encode()) and not slow_bad(line), line


def slow_lines(docs):
    space = " \t\n\x0b\x0c\r"
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    holders = defaultdict(set)
    key = lambda x: x.strip(space).translate(low)
    order = lambda i: (i is not None, i or 0)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("runs", [None, 2, 8, 60])
def test_line_dedup_matches_brute_force(spark, sf, odd_docs, runs):
    docs = table(spark, sf, "documents")
    got = (linededup.digest(docs, Workspace(spark, "t"), runs=runs) if runs else entries.op6_line_dedup(spark, sf)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == slow_lines(texts(spark, sf))
    got = linededup.digest(odd_docs, Workspace(spark, "t"), runs=runs).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == slow_lines([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_line_dedup_with_one_hot_line_over_many_runs(spark):
    rows = [(i, f"shared line number one is here\n{i} own line, long enough to count\nshared line number one is here") for i in range(3000)]
    rows += [(i, f"pair line held by {i // 2} and no other") for i in range(5000, 5400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = linededup.digest(docs, Workspace(spark, "t"), runs=37).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == slow_lines(rows)


def test_line_dedup_bitmaps_and_texts(spark, odd_docs, no_docs):
    maps = linededup.keep_bitmaps(odd_docs, Workspace(spark, "t")).collect()
    assert all(zlib.decompress(r.bitmap) for r in maps)
    kept = linededup.dedup(odd_docs, Workspace(spark, "t"))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert linededup.digest(no_docs, Workspace(spark, "t")).count() == 0


def test_secrets_match_brute_force(spark, sf, odd_docs, no_docs):
    extra = [
        (1, "password: token = abcdefghij"),
        (2, "apikey='k' é api_key: 'ABCD+/=.-_99' PassWD=12345678"),
        (3, "ghp_" + "a1B2" * 10 + " xoxb-123456789012-abc AIza" + "x" * 35 + " -----BEGIN RSA PRIVATE KEY-----"),
        (4, "AKIASHORT AKIA0123456789AB " + "f" * 31 + " " + "0" * 32 + "\U0001f600 secret=ABCDEFGH"),
        (6, "0123456789abcdef" * 2 + (" é secret=ABCDEFGH " + "f" * 33) * 700),
        (7, None),
        (5, "sk_live_" + "a" * 20 + " eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"),
    ]
    docs = spark.createDataFrame(extra, "doc_id long, text string")
    for d in (docs, odd_docs, table(spark, sf, "documents")):
        got = Counter((r.doc_id, tuple((x.start, x.rank, x.end) for x in r.found)) for r in secrets.find(d, Workspace(spark, "t")).collect())
        assert got == Counter((r.doc_id, tuple(secrets.brute_force(r.text))) for r in d.collect())
    row = {r.doc_id: r for r in secrets.digest(docs, Workspace(spark, "t")).collect()}[2]
    base = [f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in secrets.brute_force(extra[1][1]) if k < 3]
    assert row.n_assign == 2 and row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert secrets.digest(no_docs, Workspace(spark, "t")).count() == 0


def test_values_of_clashing_columns_come_back(spark, odd_docs):
    """Columns named like those the operators use inside keep their values."""
    from lakeforge.llm import decontam, lshforest, pii

    extra = [c for c in odd_docs.columns if c not in ("doc_id", "text", "n_chars")]
    values = {tuple(r) for r in odd_docs.select(*extra).collect()}
    assert len(values) == 1
    items = spark.createDataFrame([(1, "nothing of the kind is in there")], "item_id long, text string")
    for out in (
        quality.clean(odd_docs),
        linededup.dedup(odd_docs, Workspace(spark, "t")),
        lshforest.dedup(odd_docs, Workspace(spark, "t")),
        decontam.clean(odd_docs, items),
        pii.replace(odd_docs, Workspace(spark, "t")),
    ):
        assert {tuple(r) for r in out.select(*extra).collect()} == values and set(odd_docs.columns) <= set(out.columns)


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{32,}") is secrets.ANY
    assert secrets.trigram_query("AKIA[A-Z]+") == ("and", ("aki", "kia"))
    assert secrets.trigrams_of(secrets.trigram_query("(abc|xyz)[0-9]def")) == {"abc", "xyz", "def"}
    assert secrets.trigram_query("(abc)?[0-9]") is secrets.ANY


def test_flow_moves_the_fewest_bytes():
    flow = resharding.min_cost_flow([10, 20, 30], [15, 15, 15, 15], lambda i, j: int(i != j))
    assert [sum(r) for r in flow] == [10, 20, 30] and [sum(c) for c in zip(*flow, strict=True)] == [15] * 4
    assert sum(flow[i][j] for i in range(3) for j in range(4) if i != j) == 20


def least_moved(total, capacity):
    """The fewest bytes that leave their shard, by trying all that each old shard may keep."""
    return sum(max(0, n - (capacity[o] if o < len(capacity) else 0)) for o, n in total.items())


def test_plan_moves_the_fewest_bytes():
    """Against brute force: what a shard keeps is bounded by its size and its capacity, and no more need move."""
    import random

    rng = random.Random(5)
    for _ in range(200):
        olds, news, blocks = rng.randrange(1, 5), rng.randrange(1, 6), rng.randrange(1, 6)
        sizes = {o * blocks + b: rng.randrange(1, 50) for o in range(olds) for b in range(blocks) if rng.random() < 0.8}
        if not sizes:
            continue
        owner, cut, cost = resharding.plan(sizes, blocks, news)
        got, moved = Counter(), 0
        for b, n in sizes.items():
            runs, at = ([(n, owner[b])] if b in owner else cut[b]), 0
            assert runs[-1][0] == n and len(runs) == len({j for _, j in runs})
            for end, j in runs:
                assert end > at
                got[j] += end - at
                moved += (end - at) * (j != b // blocks)
                at = end
        total, all_bytes = Counter(), sum(sizes.values())
        for b, n in sizes.items():
            total[b // blocks] += n
        capacity = [all_bytes // news + (j < all_bytes % news) for j in range(news)]
        assert [got[j] for j in range(news)] == capacity and moved == cost == least_moved(total, capacity)
        assert len(cut) < olds + news


def test_transfer_moves_the_files(spark, sf, odd_docs, no_docs):
    """The new shards hold each row once, near equal in bytes, and all but the cut blocks' files stay."""
    for docs, least in ((table(spark, sf, "documents"), 4), (odd_docs, 2), (no_docs, 4)):
        layout = resharding.transfer(docs, Workspace(spark, "t"), least=least)
        rows = resharding.read(layout, whole=True)
        assert Counter(map(repr, rows.select("row.*").collect())) == Counter(map(repr, docs.collect()))
        rows = rows.collect()
        slots, total, moved = defaultdict(list), Counter(), 0
        for r in rows:
            body = (r.row.text or "").encode()
            assert (r.doc_id, r.size, r.text_crc32) == (r.row.doc_id, len(body) + 1, zlib.crc32(body)) and r.moved == (r.shard != r.old_shard)
            slots[r.shard].append(r.slot)
            total[r.shard] += r.size
            moved += r.size * r.moved
        assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(total) <= set(range(8))
        sizes = [r.size for r in rows]
        if least == 4 and rows:
            assert max(total.values()) - min(total[j] for j in range(8)) < max(sizes) and abs(moved - layout.cost) < 8 * max(sizes)
        old = Path(f"{layout.ws.path}/old".removeprefix("file://"))
        assert not any((old / f"block={b}").exists() for b in layout.cut) and all((old / f"block={r.block}").exists() for r in layout.manifest.collect())
        assert layout.cut or not rows
    whole = {r.doc_id: r for r in entries.op8_min_cost_resharding(spark, sf).collect()}
    assert whole.keys() == {r.doc_id for r in table(spark, sf, "documents").collect()}


def test_transfer_from_a_given_layout(spark):
    """Shards that fit stay whole; the files of the one that is too large are all that is touched."""
    docs = spark.createDataFrame([(i, "x" * 99, 0 if i < 40 else 1) for i in range(60)], "doc_id long, text string, home int")
    layout = resharding.transfer(docs, Workspace(spark, "t"), 2, 2, least=4, given="home")
    rows = resharding.read(layout).collect()
    assert Counter(r.shard for r in rows) == {0: 30, 1: 30} and sum(r.size for r in rows if r.moved) == layout.cost == 1000 and len(layout.cut) <= 1
