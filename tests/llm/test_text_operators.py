import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seedsift.llm import chat, decontaminate, licenses, line_templates, quality_knn, quality_rules, url_filter
from tests.conftest import DATA

SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "   \n \n"), (4, "x"), (4, "x"), (None, "under the mit license")]


# quality rules -------------------------------------------------------------------------------------------------------


def rules_brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    n, chars, symbols, dup = len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text or ""), len(lines) - len(set(lines))
    failed = n < 50 or 100 * len(hit) > 50 * n
    upper = sum("A" <= c <= "Z" for c in text or "")
    letters, bullets = sum(bool(re.search(r"[A-Za-z\x80-\U0010ffff]", w)) for w in words), sum(bool(re.match(r"[\x20\x09-\x0D]*[-*\u2022]", x)) for x in lines)
    ellipses = sum(x.rstrip(" \t\n\x0b\f\r").endswith(("...", "\u2026")) for x in lines)
    other = 10 * symbols > 3 * n or (n and not 2 * n <= chars <= 20 * n) or 10 * dup > 5 * len(lines) or 10 * upper > 6 * chars
    other = other or 10 * letters < 7 * n or 10 * bullets > 9 * len(lines) or 10 * ellipses > 3 * len(lines)
    return n, chars, symbols, dup, len(hit), failed, not failed and not other


def test_rules_match_brute_force(spark):
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect())]
    plain = [f"word{i} and" for i in range(60)]
    rows += [(300, "\n".join(f"- {x}" for x in plain)), (301, "\n".join(f"{x} ..." for x in plain)), (302, "\n".join(f" \u2022{x}\u2026" for x in plain)), (303, " ".join(f"x{i} {i} {i}1" for i in range(60))), (304, "\n".join(plain)), (305, "\n".join([*plain, *plain[:5]]))]
    rows += [(100 + i, t) for i, (_, t) in enumerate(ODD)] + [(200, "a b c a b c a b c x\na b c\na b c"), (201, "aa " * 60), (202, "WORD! " * 30 + " ".join(f"Word{i}" for i in range(60)))]
    got = quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == rules_brute(dict(rows)[r.doc_id]), r.doc_id
    assert len(got) == len(rows) and quality_rules.judge(spark.createDataFrame([], SCHEMA + ", kept boolean")).count() == 0


def test_colliding_hashes_do_not_change_counts(spark, monkeypatch):
    """With 8 and 4 bits of hash left, and with places that do not fit, windows are told apart by their words."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    for bits in (56, 60, 2):
        monkeypatch.setattr(quality_rules, "POS_BITS", bits)
        got = quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {r.doc_id: r.n_repeat_words for r in got} == {i: rules_brute(t)[4] for i, t in rows}


def test_rules_on_empty_long_and_clashing_input(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum dolor " * 60_000, 5, 6)], SCHEMA + ", _words long, n_words long")
    row = quality_rules.judge(docs).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed, row._words) == (180_000, 180_000, True, 5)
    assert quality_rules.judge(docs.where("false")).columns == ["doc_id", "text", "_words", *quality_rules.RESULTS]


def test_rule_order_does_not_change_verdicts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    two = {r.doc_id: r.kept for r in quality_rules.judge(docs, rules=quality_rules.RULES[::-1]).collect()}
    assert one == two


# URL filter ----------------------------------------------------------------------------------------------------------


def url_brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(url_filter._UPPER, url_filter._LOWER)), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls_match_brute_force(spark):
    urls = [None, "", "no scheme", "http://NET/x", "https://a.net", "ftp://example.net/en/a?b#c", "http://example.net/e", "http://x.example.com/de/", "http://example.com/d", "http://a.org/fr/x", "http://borg/fr/", "http://net:80/", "x://a.net/?q", "http://://net/", "http://a.b.c.d.net/\n/z", "http://net/", "http://net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    for broadcast in (url_filter.BROADCAST_RULES, 0):
        url_filter.BROADCAST_RULES, kept = broadcast, url_filter.BROADCAST_RULES
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
        url_filter.BROADCAST_RULES = kept
        assert got == {i: url_brute(u, url_filter.RULES) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.where("false")).collect()} == {"allow"}


def test_long_rules_and_hosts(spark):
    """Rules of any length, rules without host or path, hosts of very many labels, clashing columns, no pages."""
    long = "/" + "p" * 5000
    rules = [("x.net", long, "block"), ("net", None, "allow"), (None, "/", "block"), ("a.b.x.net", "/", "allow")]
    urls = [f"http://x.net{long}/q", f"http://x.net{long[:-1]}", "http://a.b.x.net/", "http://" + "l." * 20_000 + "x.net" + long]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, frame).collect()}
    assert got == {0: ("x.net" + long, "block"), 1: ("net", "allow"), 2: ("a.b.x.net/", "allow"), 3: ("x.net" + long, "block")}
    assert url_filter.judge_urls(pages.where("false"), frame).count() == 0


# licenses ------------------------------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_licenses_match_brute_force(spark):
    phrases = {x.words: x.label for x in licenses.NOTICES if x.base}
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet(f"{DATA}/documents.parquet").collect())]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(ODD)] + [(2000, "Released UNDER the MIT-License. under the mit license; cc by nc by nc cc by nc, Apache License,\nVersion 2"), (2001, "xunder the mit license under the mit licensee")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in rows:
        w, places, labels = words_of(t), [], set()
        for p, label in phrases.items():
            p = p.split()
            here = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))), i
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_catalogue_of_notices(spark):
    """Each notice is found in clean text, with one letter changed where edits are allowed, under its own label; clean text has none."""
    clean = " ".join(f"word{i} and other text of a page about something else entirely" for i in range(40))
    scan = licenses.Scanner().scan
    assert len(licenses.NOTICES) >= 60 and scan(clean)[5] == ""
    for x in licenses.NOTICES:
        assert x.label in scan(f"{clean} {x.words.upper()}. {clean}")[5].split(",")
        if x.edits:
            at = len(x.words) // 2
            changed = x.words[:at] + ("q" if x.words[at] != "q" else "z") + x.words[at + 1 :]
            assert x.label in scan(f"{clean} {changed} {clean}")[5].split(","), changed
    for text, label in (
        ("under the terms of the MIT License", "mit"), ("SPDX-License-Identifier: MIT", "mit"), ("BSD 3-Clause License", "bsd-3"), ("GNU Lesser General Public License v3", "lgpl"), ("Creative Commons Attribution-NonCommercial", "cc-by-nc"),
        ("SPDX-License-Identifier: GPL-2.0", "gpl-2"),
    ):
        assert scan(text)[5].split(",") == [label] and scan(text)[1] == 0
    documents = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    for r in documents:
        labels = set(scan(r.text)[5].split(",")) - {""}
        said = " ".join((r.text or "").lower().replace("-", " ").split())
        assert not labels or any(w in said for w in ("licen", "cc by", "public domain", "permission", "redistribution")), r.doc_id
    table = spark.createDataFrame([("own", "My OWN  notice-text", 1, None), ("x", None, 0, False), ("own", "!!", 0, False)], "label string, words string, edits int, base boolean")
    own = licenses.notices_of(table)
    assert own == (licenses.Notice("own", "my own notice text", 1),) and licenses.Scanner(own).scan("see my own notise text")[5] == "own"


def test_licenses_on_empty_long_and_clashing_input(spark):
    text = "word under the mit license " * 40_000 + "under the mitt license"
    frame = spark.createDataFrame([(1, text, "x")], SCHEMA + ", labels string")
    row = licenses.scan_licenses(frame).first()
    assert (row.n_base, row.first_word, row.labels, len(row.spans)) == (40_000, 1, "mit", 40_001)
    assert licenses.scan_licenses(frame.where("false")).count() == 0


def test_fuzzy_notices():
    scan = licenses.Scanner().scan
    assert scan("text under teh mit license here")[5] == "mit" and scan("text under teh mit license here")[1] == 0
    assert scan("under the mitt licens")[5] == "mit"
    assert "gpl-3" in scan("the GNU General Pubic License version 3 applies")[5]
    assert scan("under that nice licence")[5] == ""
    span = scan("a b under the mit licence c")[7][0]
    assert (span["start"], span["stop"], span["edits"]) == (2, 6, 1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def check_fuzzy(text):
    """Labels and spans against the edit distances of all runs of whole words."""
    w, got = words_of(text), licenses.Scanner().scan(text)
    near, labels = [], set()
    for x in licenses.NOTICES:
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                run = " ".join(w[i:j])
                if abs(len(run) - len(x.words)) <= x.edits and (e := distance(run, x.words)) <= x.edits:
                    near.append((x.label, i, j, e))
                    labels.add(x.label)
    assert got[5] == ",".join(sorted(labels)), text
    spans = [(s["label"], s["start"], s["stop"], s["edits"]) for s in got[7]]
    assert set(spans) <= set(near), text
    assert all(any(s[0] == x[0] and s[1] < x[2] and x[1] < s[2] for s in spans) for x in near), text


def test_fuzzy_notices_at_word_borders():
    scan = licenses.Scanner().scan
    for text, label in (("under the mit licenses", "mit"), ("under the mit licences", "mit"), ("GNU General Public Licenses", "gpl"), ("mozilla public licensed", "mpl-2"), ("xunder the mit license", "mit"), ("a xunder the mit licenses b", "mit")):
        assert scan(text)[5] == label, text
        check_fuzzy(text)
    assert scan("xxunder the mit licenses")[5] == "" and scan("under the mit licensing")[5] == ""


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([x for x in licenses.NOTICES if x.edits]), st.lists(st.tuples(st.sampled_from("ids"), st.sampled_from([0.0, 1.0]) | st.floats(0, 1), st.sampled_from("xse ")), max_size=5), st.sampled_from(["", "a ", "see under the ", "the mit license "]), st.sampled_from(["", " b", " license", " version 3"]))
def test_fuzzy_notices_match_brute_force(notice, edits, before, after):
    text = notice.words
    for kind, place, c in edits:
        k = int(place * len(text))
        text = text[:k] + (c if kind != "d" else "") + text[k + (kind != "i") :]
    check_fuzzy(before + text + after)


# decontamination -----------------------------------------------------------------------------------------------------


def contamination_brute(text, items, size=13):
    w, hit, found = words_of(text), set(), set()
    for name, t in items:
        v = words_of(t)
        for k in range(max(1, len(v) - size + 1)) if v else ():
            x = v[k : k + size]
            for at in range(len(w) - len(x) + 1):
                if w[at : at + len(x)] == x:
                    hit |= set(range(at, at + len(x)))
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_matches_brute_force(spark, monkeypatch):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    items = [(1, base), (2, base.upper()), (3, "short item"), (4, ""), (5, None), (6, "item"), (7, "x " * 20)]
    docs = [*ODD[:5], (10, "a " + base + " b"), (11, "a; ONE, two (three) four five six seven eight nine ten eleven twelve thirteen"), (12, "very short item twice short item"), (13, base + " " + "pad " * 400), (14, "x " * 30)]
    frame, bench = spark.createDataFrame(docs, SCHEMA + ""), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *contamination_brute(t, items)) for i, t in docs)
    for limit in (decontaminate.BLOCK_BYTES, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = decontaminate.scan_documents(frame, bench).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert decontaminate.scan_documents(frame, bench.where("false")).where("contaminated").count() == 0


def test_items_without_id_hit(spark, monkeypatch):
    """As in OP7_SQL: their hits count, together they are one item, and no name is listed."""
    docs = spark.createDataFrame([(1, "a short item b"), (2, "other words and short item"), (3, "none")], SCHEMA)
    bench = spark.createDataFrame([(None, "short item"), (None, "other words"), (5, "and")], "item_id long, text string")
    for limit in (decontaminate.BLOCK_BYTES, 30):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = sorted((r.doc_id, r.n_hit, r.n_items, r.contaminated, r["items"]) for r in decontaminate.scan_documents(docs, bench).collect())
        assert got == [(1, 2, 1, True, []), (2, 5, 2, True, ["5"]), (3, 0, 0, False, [])]


def test_large_benchmark_in_blocks(spark, monkeypatch):
    """Five megabytes of items in one automaton and in blocks: the same, with offsets of the original text."""
    rng = random.Random(6)
    items = [(k, " ".join(f"{rng.getrandbits(20):x}" for _ in range(90))) for k in range(9500)]
    assert sum(len(t) for _, t in items) > 5_000_000
    docs = [(k, f"Before (the) {items[37 * k][1].upper()} -- AFTER\n" + " ".join(items[k][1].split()[:12])) for k in range(20)] + [(50, "clean"), (51, None)]
    docs = spark.createDataFrame([(*d, "z") for d in docs], SCHEMA + ", items string")
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    seen = []
    for limit in (decontaminate.BLOCK_BYTES, 100_000_000):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        rows = decontaminate.scan_documents(docs, bench).collect()
        seen.append(sorted(map(str, rows)))
        for r in rows:
            assert r.contaminated == (r.doc_id < 50) and r["items"] == ([str(37 * r.doc_id)] if r.doc_id < 50 else [])
            assert [r.text[x.start : x.stop].lower() for x in r.offsets] == ([items[37 * r.doc_id][1]] if r.doc_id < 50 else [])
    assert seen[0] == seen[1]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["a", "ab", "abcd"]), st.lists(st.integers(0, 40), max_size=4), st.integers(0, 100), st.randoms(use_true_random=False))
def test_windows_match_brute_force(letters, sizes, n, rng):
    items = [(str(k), " ".join(rng.choice(letters) for _ in range(m))) for k, m in enumerate(sizes)]
    text = " ".join([*(rng.choice(letters) for _ in range(n)), *(t for _, t in items[:1])])
    words = decontaminate.normalised(text)
    spans, found = decontaminate.Automaton(items).scan(words)
    assert (len(words), sum(b - a for a, b in spans), len(found)) == contamination_brute(text, items)[:3]


def test_offsets_of_the_original():
    text = "Äb, c-d  E9!"
    assert decontaminate.original_offsets(text, [(0, 2), (3, 4)]) == [(0, 5), (9, 11)]


# chat ----------------------------------------------------------------------------------------------------------------

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, " ", "\\", "\n", "a", "]", "[", "s", "INST", " [/INST]", " </s>", "[/ROLE]"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECES), PIECES), max_size=6))
def test_chat_round_trip(turns):
    rendered = "".join(chat.render_turn(r, t) for r, t in turns)
    assert chat.parse(rendered) == turns


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.sampled_from(["user", "assistant", "system"]), PIECES), PIECES)
def test_control_strings_are_marks_only(role, text):
    made = chat.render_turn(role, text)
    _, _, start, stop, end = chat.parse_turn(made)
    body, head = made[start:stop], made[:start]
    assert end == len(made) and not any(c in body for c in chat.CONTROLS)
    assert head in ("[INST] ", " ") or head.startswith("[ROLE ") and not any(c in head[6:] for c in chat.CONTROLS)
    assert (body == text) == ("\\" not in text and not any(c in text for c in chat.CONTROLS))


def test_contract_conversation():
    assert chat.render_turn("assistant", chat.TRICKY) == " <\\/s>[\\INST] ok [\\/INST] </s>"
    assert chat.parse_turn(" </s>[INST] ok [/INST] </s>") is None or chat.parse_turn(" </s>[INST] ok [/INST] </s>")[1] != chat.TRICKY
    assert chat.parse_turn("[INST] a <s> b [/INST]") is None and chat.parse_turn("[INST] a\\ [/INST]") is None


def test_chat_on_empty_long_and_clashing_input(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "</s>", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, segment string")
    row = chat.digests(chat.format_turns(frame)).first()
    assert row.n_turns == 1 and row.turns_sha256 == hashlib.sha256(f"user\n{rows[0][3]}\n".encode()).hexdigest()
    assert chat.digests(chat.format_turns(frame.where("false"))).count() == 0


def test_chat_digests(spark):
    rows = [(7, 1, "assistant", chat.TRICKY), (7, 0, "user", "hi"), (7, 1, "assistant", None), (8, None, None, "x\\y"), (None, 0, "tool", "z")]
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()}
    assert got[7].turns_sha256 == hashlib.sha256(f"user\nhi\nassistant\n\nassistant\n{chat.TRICKY}\n".encode()).hexdigest()
    assert (got[7].loss_chars, got[7].loss_sha256) == (len(chat.TRICKY), hashlib.sha256(chat.TRICKY.encode()).hexdigest())
    assert got[8].n_turns == 1 and got[8].turns_sha256 == hashlib.sha256(b"\nx\\y\n").hexdigest() and got[None].n_turns == 1


# line templates ------------------------------------------------------------------------------------------------------


def lines_brute(rows):
    """The same rules, one line after the other."""
    lines = {}
    for i, t in rows:
        if i is None:
            continue
        for m in {tuple(m) for x in line_templates.lines_of(t) if (m := line_templates.masked(x)) is not None}:
            lines.setdefault(m, set()).add(i)
    leaves = {}
    for m in lines:
        leaves.setdefault((len(m), m[: line_templates.DEPTH]), []).append(m)
    owner = {m: min(d) for m, d in lines.items() if len(d) >= line_templates.MIN_DOCS}
    for members in leaves.values():
        members.sort(key=lambda m: (-len(lines[m]), b" ".join(m).decode()))
        clusters = {}
        for m, k in zip(members, line_templates.cluster([list(m) for m in members])):
            clusters.setdefault(k, []).append(m)
        for c in clusters.values():
            docs = [d for m in c for d in lines[m]]
            if len(members) > 1 and len(docs) >= line_templates.MIN_COVERED and min(docs) < max(docs):
                owner |= {m: min(docs) for m in c}
    out = []
    for i, t in rows:
        kept = [x for x in line_templates.lines_of(t) if i is None or (m := line_templates.masked(x)) is None or owner.get(tuple(m), i) >= i]
        out.append((i if i is not None else -1, None if t is None else b"\n".join(kept).decode()))
    return sorted(out, key=str)


def test_line_templates_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(1000 + k, f"Posted by user{k} on day {k} of the year\nown line number of its own kind {'abcdefgh'[k]}") for k in range(6)]
    rows += [(2000 + k, f"the same line with one {w} word in it only\nshort line") for k, w in enumerate(["red", "green", "blue", "white", "black"])]
    rows += [(None, "the same line with one red word in it only"), (3000, None), (3001, "")]
    got = line_templates.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA + "")).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in got), key=str) == lines_brute(rows)


def test_lines_of_empty_and_long_input(spark):
    text = "\n".join(f"a line of its own with {i:b} in it".translate(str.maketrans("01", "no")) for i in range(40_000))
    docs = spark.createDataFrame([(1, "short\n" + text), (2, text)], SCHEMA)
    rows = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    assert (rows[1].n_dropped, rows[1].text) == (0, "short\n" + text) and (rows[2].n_dropped, rows[2].text) == (40_000, "")
    assert line_templates.drop_recurring_lines(docs.where("false")).count() == 0


def test_leaves_in_blocks(spark, monkeypatch):
    """With blocks smaller than a leaf nothing fails, and exact repetitions still go."""
    monkeypatch.setattr(line_templates, "BLOCK", 3)
    rows = [(k, f"the same start of {chr(97 + k % 26)}{chr(97 + k // 26)} line here now\nan exact line that recurs here") for k in range(40)]
    got = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "exact" in got[0] and not any("exact" in got[k] for k in range(1, 40))


def test_large_leaf_equals_the_definition(spark, monkeypatch):
    """A hot leaf of many templates gives what clustering the whole leaf in order gives, whatever BLOCK is."""
    rows = [(4 * t + k, f"the same start of template {' '.join(3 * [f'{t:06b}'])} and {w}".translate(str.maketrans("01", "no"))) for t in range(60) for k, w in enumerate(["red", "green", "blue", "7"])]
    want = lines_brute(rows)
    assert sum(t == "" for _, t in want) == 180
    for block in (3, line_templates.BLOCK):
        monkeypatch.setattr(line_templates, "BLOCK", block)
        got = line_templates.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == want


@settings(max_examples=300, deadline=None)
@given(st.integers(5, 12).flatmap(lambda n: st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", line_templates.ANY]), min_size=n - 3, max_size=n - 3), min_size=1, max_size=60)))
def test_indexed_templates_equal_the_definition(tails):
    sequences = [[b"x", b"y", b"z", *t] for t in tails]
    made, first = line_templates.Templates(len(sequences[0])), {}
    want = [first.setdefault(k, i) for i, k in enumerate(line_templates.cluster(sequences))]
    assert [made.join(i, s) for i, s in enumerate(sequences)] == want


# quality classifier --------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    sf = DATA.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality_knn.op4_quality_knn(spark, sf).collect()
    known = [r for r in got if r.held_out and r.doc_id in labels]
    assert len(known) > 40 and sum(r.predicted == labels[r.doc_id] for r in known) >= 0.93 * len(known)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == 1 for r in known if labels[r.doc_id] == 1)


def test_scores_match_plain_cosine_voting(spark):
    """The blocked products and partial sorts against one sum after the other."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = quality_knn.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    got = {r.doc_id: (r.text, r.score) for r in quality_knn.score_documents(docs, model).collect()}
    counter, sample = quality_knn.Counter(), model.vectors.astype(float)
    for text, score in got.values():
        x = np.log1p(counter.counts(text).astype(float)) * model.idf
        x = x @ model.projection
        if not x.any():
            assert score == 0
            continue
        cosines = sorted(((sum(a * b for a, b in zip(x / np.linalg.norm(x), v)), label) for v, label in zip(sample, model.labels)), reverse=True)
        near = [(max(c, 0) ** 4, label) for c, label in cosines[: quality_knn.VOTERS]]
        assert abs(score - sum(w * q for w, q in near) / sum(w for w, _ in near)) < 1e-4


def test_fit_does_not_depend_on_the_dealing_of_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    one, two = quality_knn.fit(docs, labels), quality_knn.fit(docs.repartition(7, "text"), labels.repartition(3))
    assert np.array_equal(one.labels, two.labels) and np.allclose(one.vectors, two.vectors)


def test_classifier_on_empty_long_and_clashing_input(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, "a", "b")], SCHEMA + ", score string, predicted string")
    model = quality_knn.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    row = quality_knn.score_documents(docs, model).first()
    assert (round(row.score, 3), row.predicted) == (1.0, 1)
    assert quality_knn.score_documents(docs.where("false"), model).count() == 0


def test_classifier_on_odd_rows(spark):
    docs = spark.createDataFrame([(k, f"some clean words here number {k}") for k in range(40)] + [(50 + k, "!!! ### $$$ %%%") for k in range(40)] + ODD[:3], SCHEMA + "")
    labels = spark.createDataFrame([(k, int(k < 50)) for k in range(90)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    scored = {r.doc_id: r.score for r in quality_knn.score_documents(docs, quality_knn.fit(docs, labels)).collect()}
    assert scored[1] == 0 and scored[2] == 0 and scored[10] > 0.9 and scored[60] < 0.1
    none = quality_knn.score_documents(docs, quality_knn.fit(docs, labels.where("false"))).collect()
    assert all(r.score == 0 for r in none)
