"""Each operator against a brute-force version, and on nulls, empty and very long texts, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import decontamination, main_text, order_minhash, packing, pii, pu_quality, quality_rules, substrings, token_files, tokens, url_cascade
from riskloom.llm.components import components

ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+")
VOCABULARY = [f"w{i}" for i in range(900)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, key int, words string"


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs, with extra columns that clash with names the operators use."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).coalesce(2)

    return make


def words_of(text):
    return ALNUM.findall((text or "").encode().lower())


def prose(n, seed):
    return random.Random(seed).choices(VOCABULARY, k=n)


def corpus():
    """Copies, near copies, shared passages, odd texts, repeated rows and null ids."""
    a, b, passage, tail = prose(300, 1), prose(400, 2), prose(80, 3), prose(60, 4)
    edit = lambda w, *at: [x + "x" if i in at else x for i, x in enumerate(w)]
    texts = [a, a, edit(a, 150), edit(a, 20, 250), b, edit(b, 100, 101), prose(30, 5) + passage + prose(40, 6), prose(50, 7) + passage + tail,
             tail + prose(33, 8), passage, prose(49, 9), ["same"] * 120, ["same"] * 90, ["a", "b"] * 70, prose(6000, 10) + passage]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    return rows + [(20, None), (21, ""), (22, " \n\t "), (23, "one two"), (23, "one two"), (24, rows[4][1]), (24, rows[4][1]), (None, rows[0][1]), (25, "É ünï " * 60)]


def test_decontamination_matches_brute_force(spark, frame):
    rows = corpus()
    items = [(1, " ".join(prose(80, 3)[10:40])), (2, "One, TWO"), (3, None), (4, ""), (5, " ".join(prose(400, 2)[5:17])), (5, " ".join(prose(400, 2)[5:17])), (10, "same")]
    got = sorted(map(tuple, decontamination.find_contamination(frame(rows), spark.createDataFrame(items, "item_id long, text string"))
                     .select("doc_id", "n_words", "n_hit", "n_items", "items").collect()), key=repr)
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add(item)
    want = []
    for doc_id, text in rows:
        w, hit, named = words_of(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i:i + n])):
                    hit |= set(range(i, i + n))
                    named |= found
        want.append((doc_id, len(w), len(hit), len(named), sorted(map(str, named))))
    assert got == sorted(want, key=repr)
    assert sum(x[2] > 0 for x in got) >= 6
    none = decontamination.find_contamination(frame(rows), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(rows)
    assert decontamination.find_contamination(frame([]), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_substrings_match_brute_force(frame):
    rows = corpus()
    got = sorted(map(tuple, substrings.remove_repeats(frame(rows)).collect()), key=repr)
    first, cut = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for doc_id, w in cut:
        for i in range(len(w) - 49):
            if doc_id is not None:
                key = tuple(w[i:i + 50])
                first[key] = min(doc_id, first.get(key, doc_id))
    want = []
    for doc_id, w in cut:
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if doc_id is not None and first[tuple(w[i:i + 50])] < doc_id:
                keep[i:i + 50] = [False] * 50
        left = b" ".join(x for x, ok in zip(w, keep) if ok)
        want.append((doc_id, len(w), len(w) - sum(keep), hashlib.sha256(left).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sum(x[2] for x in got) > 900
    assert substrings.remove_repeats(frame([])).count() == 0


def test_near_duplicates_match_brute_force(frame):
    rows = [(i, t) for i, t in corpus() if i is not None]
    got = order_minhash.near_duplicates(frame(rows)).collect()
    shingles = {}
    for n, (_, text) in enumerate(rows):
        w = words_of(text)
        shingles[n] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else None
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in shingles.items():
        for j, b in shingles.items():
            if i < j and a and b and (words_of(rows[i][1]) == words_of(rows[j][1]) or len(a & b) >= 0.8 * len(a | b) and len(a) > 20):
                root[top(i)] = top(j)
    least = defaultdict(list)
    for n, (doc_id, _) in enumerate(rows):
        least[top(n)].append(doc_id)
    want = sorted((doc_id, min(least[top(n)])) for n, (doc_id, _) in enumerate(rows))
    assert sorted((r.doc_id, r.class_id) for r in got) == want
    assert sum(r.keep for r in got) == len(least)
    assert order_minhash.near_duplicates(frame([])).count() == 0


def test_large_group_of_near_copies_is_one_class(frame):
    base = prose(200, 11)
    rows = [(i, " ".join(w if j not in ((i * 7) % 200, (i * 13) % 200) else f"edit{i}" for j, w in enumerate(base))) for i in range(150)]
    rows += [(1000 + i, " ".join(prose(120, 500 + i))) for i in range(40)]
    got = order_minhash.near_duplicates(frame([(999, " ".join(base)), *rows]), bucket=8).collect()
    assert {r.class_id for r in got if r.doc_id < 1000} == {0}
    assert len({r.class_id for r in got if r.doc_id >= 1000}) == 40


def test_pairs_of_a_large_bucket_keep_their_links(frame):
    """Texts of which a third is one passage share large buckets; their near copies are far from any centre."""
    passage, rows = prose(100, 13), []
    for i in range(60):
        own = prose(100, 700 + i)
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + [*own[:-1], "edit"]))]
    got = order_minhash.near_duplicates(frame(rows), bucket=2).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(i, i - i % 2) for i in range(120)]


def test_alignment_follows_order():
    a = order_minhash.shingles([w.encode() for w in prose(200, 12)])
    assert order_minhash.similarity(a, a) == 1
    assert order_minhash.similarity(a, np.concatenate([a[100:], a[:100]])) < 0.8
    assert order_minhash.similarity(a, a[:150]) == 0


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def test_aligned_matches_plain_lcs(monkeypatch):
    rng = random.Random(14)
    for columns in (7, 4096):
        monkeypatch.setattr(order_minhash, "COLUMNS", columns)
        for _ in range(200):
            a, b = ([rng.randrange(rng.choice((2, 5, 40))) for _ in range(rng.randint(0, 40))] for _ in range(2))
            assert order_minhash.aligned(np.array(a, np.uint64), np.array(b, np.uint64)) == plain_lcs(a, b)


def test_copies_of_texts_with_repeated_lines(frame):
    """An edit near the front moves the occurrence numbers of all later repeats of a line."""
    rows = []
    for i in range(6):
        line, blocks = prose(10, 800 + i), [prose(10, 900 + 20 * i + j) for j in range(20)]
        base = [w for b in blocks for w in line + b]
        rows += [(10 * i, base), (10 * i + 1, [*base[:4], "edit", *base[5:]]), (10 * i + 2, line + base), (10 * i + 3, base[10:])]
    grams = {i: [tuple(w[k:k + 5]) for k in range(len(w) - 4)] for i, w in rows}
    for i, a in grams.items():
        for j, b in grams.items():
            n, (u, v) = plain_lcs(a, b) if i // 10 == j // 10 else 0, (order_minhash.plain_shingles([w.encode() for w in dict(rows)[x]]) for x in (i, j))
            got = order_minhash.similarity(order_minhash.labelled(u), order_minhash.labelled(v), 0.8, u, v)
            assert got == n / (len(a) + len(b) - n) if n else got < 0.8
            assert (got >= 0.8) == (i // 10 == j // 10)
    got = order_minhash.near_duplicates(frame([(i, " ".join(w)) for i, w in rows])).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(i, i - i % 10) for i, _ in rows]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 99), (99, 98), (7, 3)], "u long, v long")
    got = {r.u: r.root for r in components(links).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {100: 98, 99: 98}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


ODD = ["a  b\n\n c\t d \x1c e f  ", "  lead", "Σας ΟΔΟΣ. x<|endoftext|> y", "don't I'll  \u3000x  ", "a,'s b.'t x²,3½! e\u0301, _a_, 12a, it's,'s", "İ I\u0307 KÅ A\u030a.", ""]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_encode_as_whole_texts(name, kind):
    whole, rng = Tokenizer.from_file(public_tokenizers.path(name)), random.Random(8)
    pools = ["abc,.;:!?|()'\" \n", "aA sS'tT12  ", "İıſÀé.,! \u0301\u0307", "".join(map(chr, range(32, 1400))), "".join(map(chr, range(0x0900, 0x0980))) + " .,a", "<|endoftx>a ", "日本語한ไท😀\u200d\ufe0f x.", "\x1c\x1d\u2003\u2000\x85 \t\na."]
    odd = [*ODD, "a<|endoftext|>b", " <|startoftext|> <|endoftext|>", "<|endoftext", "İ. क़. \u0958.", "x\u0301,"]
    for text in [*odd, *(t for _, t in corpus() if t), *("".join(rng.choices(rng.choice(pools), k=rng.randint(0, 50))) for _ in range(10000))]:
        ids = whole.encode(text, add_special_tokens=False).ids + [0]
        assert tokens.encoder(public_tokenizers.path(name), kind).encode(text) == struct.pack(f"<{len(ids)}I", *ids), text[:60]


def test_token_files_round_trip(spark, frame):
    rows = [*((i, t) for i, t in corpus() if i is not None), *((50 + i, t) for i, t in enumerate(ODD))]
    path = public_tokenizers.path("byte_bpe_50k.json")
    root = token_files.new_root(spark)
    token_files.write_token_files(frame(rows), root, path, seq_len=64, shards=3)
    got = sorted(map(tuple, token_files.read_token_files(spark, root).collect()))
    enc, at, want = tokens.encoder(path, "byte"), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1])):
        ids = enc.encode(text or "")
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == sorted(want)
    shard = token_files.open_shard(root, 0)
    ids, mask = token_files.sequence(shard.to_batches()[0], 1)
    assert len(ids) == len(mask) == 64
    empty = token_files.new_root(spark)
    token_files.write_token_files(frame([]), empty, path, shards=2)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_packing_is_gapless_and_whole(frame):
    rows = [r for r in corpus() if r[0] is not None]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(frame(rows), path).collect()
    enc, want, bins = tokens.encoder(path, "word"), [], defaultdict(list)
    for doc_id, text in rows:
        ids = enc.encode(text or "")
        for piece, at in enumerate(range(0, len(ids), 4 * 2048)):
            cut = ids[at:at + 4 * 2048]
            want.append((doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= 1 - (-sum(r.length for r in got) // 2048)
    assert packing.pack(frame([]), path).count() == 0


def test_placement_keeps_every_constraint():
    counts = {n: (n * 7) % 11 + 1 for n in range(1, 101)}
    for max_docs, max_cost in ((None, None), (3, None), (None, 5000)):
        if max_cost:
            counts = {n: c for n, c in counts.items() if n * n <= max_cost}
        load, seg = defaultdict(list), packing.place(counts, 100, max_docs, max_cost)
        for length, count in counts.items():
            mine = seg[seg[:, 0] == length]
            for rank in range(count):
                s = mine[np.searchsorted(mine[:, 1], rank, side="right") - 1]
                seq, nth = divmod(rank - s[1], s[3])
                load[s[2] + seq].append((s[4] + nth * length, length))
        for placed in load.values():
            assert [o for o, _ in sorted(placed)] == [sum(n for _, n in sorted(placed)[:i]) for i in range(len(placed))]
            assert sum(n for _, n in placed) <= 100 and len(placed) <= (max_docs or 100) and sum(n * n for _, n in placed) <= (max_cost or 10**9)


def test_rules_counts_and_verdicts(frame):
    good = " ".join(["the of and to in is that for it as", *prose(60, 20)] * 3)
    junk = " | ".join(prose(80, 21)) + " ### $$$ %%% " * 40
    rows = [*((i, " ".join(["the of and to in a is that"] * 2 + prose(400, 30 + i))) for i in range(12)), (20, junk), (21, None), (22, ""), (23, "w " * 200), (24, "x\nx\n\n x\nx"), (24, "x\nx\n\n x\nx"), (None, good)]
    got = defaultdict(list)
    for r in quality_rules.judge(frame(rows)).collect():
        got[r.doc_id].append(r)
    assert all(got[i][0].kept for i in range(12))
    assert not got[20][0].base_failed and not got[20][0].kept
    assert [got[i][0].n_words for i in (21, 22, 23)] == [0, 0, 200] and got[23][0].base_failed and got[23][0].n_repeat_words == 200
    assert len(got[24]) == 2 and got[24][0].n_dup_lines == 2 and got[24][0].word_chars == 4
    assert quality_rules.judge(frame([])).count() == 0
    for text in [t or "" for _, t in rows] + [t or "" for _, t in corpus()]:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        inside = {j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(i, i + 3)} if len(tri) < 800 else None
        counts = quality_rules.base_counts(text)
        assert counts[:3] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)))
        assert inside is None or counts[4] == len(inside)


def test_js_distance():
    p = np.array([[1.0, 0, 0], [0, 1, 0], [1, 1, 0]])
    assert np.allclose(quality_rules.js_distance(p, np.array([1.0, 0, 0])), [0, 1, 0.5579230452841438])


def test_classifier_separates_held_out_rows(spark, frame):
    rng = random.Random(5)
    rows = [(i, " ".join(prose(rng.randint(60, 200), i)) if i % 5 else "### ".join(prose(80, i))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 400, 2)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = pu_quality.score_quality(frame([*rows, (900, None), (901, ""), (901, ""), (None, "a b")]), labels).collect()
    assert len(got) == 404 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 50 and sum(r.predicted == int(r.doc_id % 5 > 0) for r in held) >= 0.95 * len(held)
    assert {r.score for r in pu_quality.score_quality(frame(rows[:3]), labels.limit(0)).collect()} == {0.5}
    assert pu_quality.score_quality(frame([]), labels).count() == 0


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "x.org/")]


def test_cascade_equals_plain_matching(spark):
    rng = random.Random(9)
    urls = [f"http{'s' * (i % 2)}://{rng.choice(['', 'a.', 'A.b.'])}{rng.choice(['example', 'x', 'net'])}.{rng.choice(['net', 'com', 'org', 'NET'])}"
            f"{rng.choice(['', '/', '/en/', '/de/1', '/fr/x?y=/en/', '?q=/en/', '#/fr/'])}" for i in range(300)]
    urls += [None, "", "no scheme", "a://", "x://net/", "http://example.net/en/a://b"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, rule string")
    got = url_cascade.judge_urls(pages, RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(rule), v, rule) for v, rule in RULES for h, p in [(rule[:rule.index("/")], rule[rule.index("/"):])]
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, verdict, rule = max(fits, default=(0, "allow", None))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert {r.verdict for r in url_cascade.judge_urls(pages, []).collect()} == {"allow"}
    assert url_cascade.judge_urls(pages.limit(0), RULES).count() == 0


def test_cascade_separates_a_large_universe(spark):
    universe = spark.range(20000).selectExpr("cast(id as string) as key")
    cascade = url_cascade.build_cascade(universe, spark.range(0, 20000, 40).selectExpr("cast(id as string) as key"))
    assert len(cascade) > 1 and sum(len(w) for *_, w in cascade) * 64 < 20 * 500
    assert [i for i in range(20000) if url_cascade.listed(str(i), cascade)] == list(range(0, 20000, 40))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and pii._luhn(digits) \
                    or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out


def test_base_identifiers_match_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a@b.co", "a@b", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4749627854990064", "4111 1111-1111 1111", "+1 (414) 555-7134", "+1", " ", "x", "é", "0001.2.3.4", "12"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert pii.find(text) == brute(text), text


def test_disguises_map_back_to_the_source(frame):
    cases = {"mail john (at) example (dot) com now": ("email", "john (at) example (dot) com"), "ask john dot doe at example dot org!": ("email", "john dot doe at example dot org"),
             "call plus one four one four five five five seven one three four.": ("phone", "plus one four one four five five five seven one three four"),
             "see j\u043ehn@example.com": ("email", "j\u043ehn@example.com"), "host 10[.]0[.]0[.]1 x": ("ip", "10[.]0[.]0[.]1"),
             "pay ４７４９６２７８５４９９００６４": ("card", "４７４９６２７８５４９９００６４")}
    for text, (kind, said) in cases.items():
        base = pii.find(text)
        assert [(k, text[s:e]) for k, s, e in pii.added(text, base)] == [(kind, said)]
        assert said not in pii.redacted(text) and f"<{kind.upper()}>" in pii.redacted(text)
    for text in ("look at example.com and dot the line", "one two three at the dot", "", "x" * 50_000, "1" * 50_000, "a." * 20_000, " ".join(prose(500, 1))):
        assert not pii.added(text, pii.find(text)) and pii.redacted(text) == text
    got = pii.find_pii(frame([(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (None, "a@b.co")])).collect()
    assert sorted(len(r.spans) for r in got) == [0, 0, 1, 1, 1]
    assert pii.find_pii(frame([])).count() == 0


def test_spelled_digits_in_short_and_mixed_runs():
    cases = {"at one nine two dot one six eight dot zero dot one now": ("ip", "one nine two dot one six eight dot zero dot one"),
             "host 192[.]one six eight[.]0 dot one": ("ip", "192[.]one six eight[.]0 dot one"),
             "call +49 one seven two 5550123 now": ("phone", "+49 one seven two 5550123"),
             "call plus four nine one seven two 555 0199.": ("phone", "plus four nine one seven two 555 0199"),
             "call plus 49 172 555 0199.": ("phone", "plus 49 172 555 0199"),
             "pay 4749 six two seven eight 5499 0064 now": ("card", "4749 six two seven eight 5499 0064"),
             "pay 4749 six two seven eight 5499 0064 one day": ("card", "4749 six two seven eight 5499 0064"),
             "use one ４７４９６２７８５４９９００６４": ("card", "４７４９６２７８５４９９００６４"),
             "mail one two (at) example (dot) com": ("email", "one two (at) example (dot) com")}
    for text, (kind, said) in cases.items():
        assert [(k, text[s:e]) for k, s, e in pii.added(text, pii.find(text))] == [(kind, said)], text
    for text in ("one of them, two at most, plus one more", "call +1 (414) 555-7134 one day", "from one two@example.com", "three point one four plus 12 is one", "un deux trois, plus un",
                 "version one dot two", "see 10.0.0.1 one more time", "pay 4749 6278 5499 0064 one day", "one@example.com", "one " * 5000, "plus " * 5000, "one dot " * 2):
        assert not pii.added(text, pii.find(text)), text


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1><a href=/>home</a></header>
<nav><ul><li><a href=/x>X</a></li></ul></nav><div class="cookie-notice">We use cookies to improve things for all of you here.</div><main><article>
<header><h1>Title &amp; more</h1></header><p>First <b>pa</b>ra\n graph<br>with words.<p>Second &lt;b&gt; caf&eacute;<ul><li>one<li>two</ul><div class="advert">Buy now</div>
<form>Name <input></form></article><section id="comments"><p>Nice one!</p></section></main><aside>side</aside><footer>end</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>unclosed <!-- x"), (4, "u", "<p>unclosed <!-- x"), (5, "u", "<div " * 3000), (6, "u", "<p>" + " ".join(prose(30000, 1)) + "</p><p>" + "a<b " * 300)]
    got = main_text.extract(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert by[1] == "Title & more First para graph with words. Second <b> café one two"
    assert by[2] == by[3] == "" and by[6].startswith(" ".join(prose(30000, 1)))
    assert main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_named_like_furniture_keep_the_article():
    at = main_text.FEATURES.index
    tree = (at("furniture"), 0.5, (at("in_article"), 0.5, (at("has_article"), 0.5, 1.0, 0.0), 1.0), 0.0)
    text = " ".join(prose(60, 15))
    inner = f"<nav>menu</nav><article><p>{text}</p><div class=advert>Buy</div></article><section id=comments><article>Nice</article></section><footer>end</footer>"
    wrappers = ["<div class='content has-sidebar'>", "<div class='no-sidebar'>", "<div class='post comments-open'>", "<div id='page-with-sidebar'>", "<div class='sidebar-right'>",
                "<form action=x>", "<div class=hasSidebar><form>"]
    for wrapper in wrappers:
        for page in (wrapper + inner, wrapper + inner.replace("<article><p>", "<main><p>").replace("</div></article>", "</div></main>")):
            assert [t for t, x in main_text.blocks(page) if main_text._keeps(tree, x)] == [text], page[:60]
    assert [t for t, x in main_text.blocks(f"<form><nav>menu</nav><p>{text}</p></form>") if main_text._keeps(tree, x)] == [text]
    kept = [t for t, x in main_text.blocks(f"<div><p>{text}</p></div><section id=comments><article>Nice one</article></section><aside><article>teaser</article></aside>") if main_text._keeps(tree, x)]
    assert kept == [text]
