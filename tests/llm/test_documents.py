"""Operators over documents against plain versions, on awkward rows."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from tests.llm import odd
from tidyloom.llm import components, decontaminate, fm_index, line_dedup, mixing, oracles, rules, sharding, simhash, substrings


@pytest.fixture(scope="module")
def docs(spark):
    return odd.table(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return odd.table(spark, [])


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(docs, none):
    rows = sharding.shard(docs, 24).select("doc_id", "text", "size", "text_crc32", "shard", "grown_shard", "slot", "law").collect()
    assert len(rows) == len(odd.texts())
    for r in rows:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 24), jump(r.doc_id or 0, 25))
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard(none, 24).count() == 0


def test_sharding_splits_a_third_of_equal_rows(spark, monkeypatch):
    """The numbering of equal rows is split by the tasks that read them, and slots stay gapless."""
    monkeypatch.setattr(sharding, "LEAST_HEAVY", 100)
    rows = [(5, "same text", "s")] * 900 + [(i, odd.prose(random.Random(i), 3), "s") for i in range(100, 1900)]
    placed = sharding.shard(odd.table(spark, rows).repartition(6), 24)
    slots = defaultdict(list)
    for r in placed.select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 2700 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_jump_moves_rows_only_into_the_new_shard(spark):
    rows = spark.range(2000).select(sharding.jump(F.col("id") * 7919 - 5000, 9).alias("j")).collect()
    moved = [r.j for r in rows if r.j.shard != r.j.grown]
    assert all(m.grown == 9 for m in moved) and 120 < len(moved) < 280


def test_shards_by_text_key(docs):
    assert sharding.assign(docs, 5, "source").groupBy("source").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0


def mixed(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(odd.words(t))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    full = {s for s in size if size[s] == 0}
    while True:
        left = sum(size.values()) - 3 * sum(size[s] for s in full)
        level = left / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in size if s not in full and 3 * size[s] < level * weight[s]}
        if not more:
            return {s: (size[s], 3.0 * size[s] if s in full else level * weight[s]) for s in size}
        full |= more


def miss(copies, size, target):
    """Half of the shortest document that was not taken once more, and a word for the whole number of the target."""
    times = int(target // size) if size else 0
    untaken = [n for c, n in copies if c == times and n]
    return (min(untaken) if untaken else max(n for _, n in copies)) / 2 + 1


@pytest.mark.parametrize("times, words, others", [(1000, 40, 31), (300, 200, 201), (300, 20, 61), (400, 7, 90)])
@pytest.mark.parametrize("same_id", [True, False])
def test_mixing_meets_targets_with_repeated_rows(spark, times, words, others, same_id):
    """A third of a source's rows are one row; sources of other sizes make all fractions occur."""
    rng = random.Random(times)
    text = lambda n: " ".join(rng.choice(odd.VOCABULARY) for _ in range(n))
    hot = text(words)
    rows = [(5 if same_id else -5 - i, hot, "s") for i in range(times)] + [(1000 + i, text(others), "s") for i in range(2 * times)]
    rows += [(10**6 + i, text(others), "t") for i in range(times)] + [(2 * 10**6 + i, hot, "u") for i in range(times // 5)]
    want, taken, copies = mixed(rows), defaultdict(int), defaultdict(list)
    for r in mixing.mix(odd.table(spark, rows)).select("source", "size", "copies", "taken").collect():
        taken[r.source] += r.taken
        copies[r.source].append((r.copies, r.size))
        assert r.copies <= 3
    assert {s: len(c) for s, c in copies.items()} == {s: sum(r[2] == s for r in rows) for s in "stu"}
    for s in want:
        assert abs(taken[s] - want[s][1]) <= miss(copies[s], *want[s]), s


def test_mixing(docs, none):
    rows = mixing.mix(docs).select("doc_id", "text", "source", "size", "source_size", "target", "copies", "taken").collect()
    want = mixed(odd.texts())
    assert len(rows) == len(odd.texts())
    taken, copies = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r.size == len(odd.words(r.text)) and r.taken == r.copies * r.size <= 3 * r.size
        assert r.source_size == want[r.source][0] and r.target == pytest.approx(want[r.source][1])
        taken[r.source] += r.taken
        copies[r.source].append((r.copies, r.size))
    for s in want:
        assert abs(taken[s] - want[s][1]) <= miss(copies[s], *want[s])
    again = mixing.mix(docs.repartition(5)).select("doc_id", "copies")
    assert odd.counted(again.collect()) == odd.counted((r.doc_id, r.copies) for r in rows)
    assert mixing.mix(none).count() == 0


def test_mixing_stops_where_shorter_documents_reach_the_target_to_the_word(spark):
    """Short documents of many sources often fill one exactly; the next size then adds none."""
    rng = random.Random(3)
    rows = [(i, odd.prose(rng, rng.choice((1, 2, 3, 5, 40))), f"s{rng.randrange(60):02d}") for i in range(1200)]
    con = duckdb.connect()
    con.register("documents", pa.table({n: [r[i] for r in rows] for i, n in enumerate(("doc_id", "text", "source"))}))
    names = ("doc_id", "source", "size", "source_size", "target", "copies", "taken")
    want = con.execute(oracles.op3_mixing()).fetchall()
    assert sorted(map(tuple, mixing.mix(odd.table(spark, rows)).select(*names).collect())) == sorted(want)


def test_mixing_without_words_and_another_seed(spark, docs):
    blank = odd.table(spark, [(1, None, "a"), (2, "", None)])
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]
    one, other = (odd.counted(mixing.mix(docs, seed=s).select("doc_id", "copies").collect()) for s in (1, 2))
    assert one != other


def measures(text):
    own = odd.words(text)
    lines = [x for x in (text or "").split("\n") if odd.words(x)]
    windows = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    repeated = {p for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), len(lines)


def test_rules(docs, none):
    rows = rules.apply_policy(rules.ledger(docs), "v2").collect()
    assert len(rows) == len(odd.texts())
    for r in rows:
        found = measures(r.text)
        assert tuple(r[m] for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")) == found
        assert r.base_failed == (found[0] < 20 or 100 * found[4] > 30 * found[0])
        assert not (r.kept and r.base_failed)
    assert rules.ledger(none).count() == 0


def test_ablation_counts_what_a_rule_alone_rejects(docs, none):
    judged = rules.ledger(docs)
    rows = judged.select("fail_bits").collect()
    own = rules.mask("v2")
    for r in rules.ablation(judged, "v2").collect():
        bit = 1 << [x.name for x in rules.RULES].index(r.rule)
        assert r.failed == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.only_by_it == sum(x.fail_bits & own == bit for x in rows)
    assert {r.failed for r in rules.ablation(rules.ledger(none), "v2").collect()} == {0}


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    source = odd.texts()
    prints = [odd.fingerprint(t) for _, t, _ in source]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = odd.roots(len(prints), links)
    least = {r: min((source[i][0] for i in range(len(source)) if root[i] == r and source[i][0] is not None), default=None) for r in set(root)}
    want = odd.counted((source[i][0], f"{prints[i]:016x}", least[root[i]]) for i in range(len(source)))
    assert odd.counted(rows) == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert simhash.near_duplicates(none).count() == 0


def test_golay_keys_meet_for_every_link():
    rng = np.random.default_rng(1)
    prints, tables = rng.integers(-(2**63), 2**63, 4000), simhash.golay_tables()
    other = prints.copy()
    for _ in range(2):
        other ^= np.int64(1) << rng.integers(0, 64, len(other))
    a, b = simhash.keys(prints, tables), simhash.keys(other, tables)
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).all()


def test_large_golay_buckets_lose_no_link(spark, monkeypatch):
    """All fingerprints near one another, paired by midpoints only."""
    rng = random.Random(2)
    prints = sorted({sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)})
    monkeypatch.setattr(simhash, "PAIRED", 1)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    at = {p: i for i, p in enumerate(signed)}
    assert all((prints[at[r.a]] ^ prints[at[r.b]]).bit_count() <= 2 for r in found)
    want = odd.roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert odd.roots(len(prints), [(at[r.a], at[r.b]) for r in found]) == want


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    rows = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    want = odd.roots(500, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert {(r.node, r.root) for r in rows} == {(n, want[n]) for n in nodes} and len(rows) == len(nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut(rows, window=35):
    places = Counter()
    for _, t, _ in rows:
        own = odd.words(t)
        places.update(tuple(own[i : i + window]) for i in range(len(own) - window + 1))
    out = []
    for i, t, _ in rows:
        own = odd.words(t)
        gone = {p for s in range(len(own) - window + 1) if places[tuple(own[s : s + window])] > 1 for p in range(s, s + window)}
        out.append((i, len(own), len(gone), " ".join(w for p, w in enumerate(own) if p not in gone)))
    return odd.counted(out)


def test_substrings(docs, none):
    found = substrings.repeats(docs)
    assert odd.counted(found.select("doc_id", "n_words", "n_removed", "kept").collect()) == cut(odd.texts())
    assert found.select("source").count() == len(odd.texts())
    assert substrings.repeats(none).count() == 0


def test_substrings_within_random_repetitive_text(spark):
    """Few words, so that anchors tie, windows overlap and zones differ."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") * rng.choice((1, 1, 2)) for _ in range(rng.randint(5, 120))), "s") for i in range(60)]
    rows += [(100 + i, (rows[i][1] + " ") * 2 + rows[i + 1][1], "s") for i in range(20)]
    found = substrings.repeats(odd.table(spark, rows), window=12)
    assert odd.counted(found.select("doc_id", "n_words", "n_removed", "kept").collect()) == cut(rows, 12)


def lines_kept(rows, similar=0.8):
    uniq = list(dict.fromkeys(x for _, t, _ in rows for _, x in line_dedup.lines(t)))
    sets = [{x[i : i + 7] for i in range(max(1, len(x) - 6))} for x in uniq]
    links = [(i, j) for i in range(len(uniq)) for j in range(i) if len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j])]
    root = dict(zip(uniq, odd.roots(len(uniq), links), strict=True))
    seen, out = {}, {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if (i, t) in out:
            continue
        kept, gone = [], 0
        for n, x in enumerate((t or "").split("\n")):
            blank = not odd.words(x)
            if blank or seen.setdefault(root[x], (i, t, n)) == (i, t, n):
                kept.append(x)
            else:
                gone += 1
        out[i, t] = len(line_dedup.lines(t)), gone, "\n".join(kept)
    return out


def test_line_dedup(spark, none):
    # Nulls in doc_id are ordered among themselves by a hash, so only one stays here.
    rng = random.Random(11)
    rows = [r for r in odd.texts() if r[0] is not None] + [(None, "a line of a document without a number", "s")]
    base = [" ".join(rng.choice(odd.VOCABULARY) for _ in range(30)) for _ in range(5)]
    for i in range(60):
        own = base[i % 5].split()
        own[rng.randrange(30)] = "changed"
        rows.append((600 + i, "\n".join((" ".join(own), base[(i + 1) % 5], "", "tiny")), "s"))
    want = lines_kept(rows)
    for r in line_dedup.dedup(odd.table(spark, rows)).collect():
        own = next(t for i, t in want if i == r.doc_id and want[i, t][0] == r.n_lines) if r.doc_id != 506 else next(t for i, t in want if i == 506)
        assert (r.n_lines, r.n_removed, r.kept) == want[r.doc_id, own]
    assert line_dedup.dedup(none).count() == 0


def test_line_dedup_of_a_hot_group_makes_rows_by_lines_not_by_pairs(spark, monkeypatch):
    """Lines of one template, most of them just under the threshold to each other, in one block and in many."""
    rng = random.Random(12)
    base = [rng.choice(odd.VOCABULARY) for _ in range(120)]
    listed = []
    for i in range(240):
        own = list(base)
        for at in rng.sample(range(120), 4 + i % 3 if i % 6 else 2):
            own[at] = "".join(rng.choice("xyzw") for _ in range(6))
        listed.append(" ".join(own))
    rows = [(i, "\n".join(listed[i : i + 4]), "s") for i in range(0, 240, 4)]
    made = []

    def counted(df):
        out = saved(df)
        made.append(out.count())
        return out

    saved = line_dedup.saved
    monkeypatch.setattr(line_dedup, "saved", counted)
    want = lines_kept(rows)
    for block in (1000, 60):
        monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
        found = line_dedup.dedup(odd.table(spark, rows)).collect()
        assert {(r.doc_id, next(t for i, t, _ in rows if i == r.doc_id)): (r.n_lines, r.n_removed, r.kept) for r in found} == want
    assert max(made) <= 12 * 240


def test_links_of_lines_join_all_that_are_similar(monkeypatch):
    rng = random.Random(13)
    base = [" ".join(rng.choice(odd.VOCABULARY) for _ in range(25)) for _ in range(3)]
    cells = []
    for n in (2, 3, 8, 9, 70):
        for _ in range(4):
            own = {}
            while len(own) < n:
                words = rng.choice(base).split() * rng.choice((1, 1, 2))
                for at in rng.sample(range(len(words)), rng.randrange(5)):
                    words[at] = rng.choice(odd.VOCABULARY)
                line = rng.choice((" ".join(words), " ".join(words), "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))))
                if line not in own.values():
                    own[rng.getrandbits(62)] = line
            cells.append(own)
    for held in (line_dedup.HELD, 300):
        monkeypatch.setattr(line_dedup, "HELD", held)
        found = list(line_dedup.links(cells))
        for own in cells:
            ids, sets = list(own), [line_dedup.shingles(x) for x in own.values()]
            true = [(i, j) for i in range(len(ids)) for j in range(i) if line_dedup.similar(sets[i], sets[j]) >= 0.8]
            place = {x: i for i, x in enumerate(ids)}
            mine = [(place[a], place[b]) for a, b in found if a in place]
            assert odd.roots(len(ids), mine) == odd.roots(len(ids), true)
            assert len(mine) < len(ids)
    assert list(line_dedup.links([])) == []


def test_counts_of_shingles_bound_what_lines_share():
    rng = random.Random(3)
    listed = ["".join(rng.choice("abc ") for _ in range(rng.choice((1, 5, 8, 40, 400)))) for _ in range(400)] + ["long " * 60_000, "x"]
    found = line_dedup.counts(listed)
    sizes = [len(line_dedup.shingles(x)) for x in listed]
    assert found.sum(axis=1).tolist() == sizes
    for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(300)):
        shared = len(line_dedup.shingles(listed[a]) & line_dedup.shingles(listed[b]))
        assert shared <= min(sizes[a], sizes[b], int(np.minimum(found[a], found[b]).sum()))
    together, alone = line_dedup.bands(listed), [line_dedup.bands([x])[0].tolist() for x in listed]
    assert together.tolist() == alone


def contamination(rows, items, window=13):
    owners = defaultdict(set)
    for name, text in items:
        own = odd.plain_words(text)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            owners[tuple(own[i : i + n])].add(name)
    out = []
    for i, t, _ in rows:
        own = odd.plain_words(t)
        hit, names = set(), set()
        for n in {len(w) for w in owners}:
            for s in range(len(own) - n + 1):
                if tuple(own[s : s + n]) in owners:
                    hit.update(range(s, s + n))
                    names |= owners[tuple(own[s : s + n])]
        names = {str(x) for x in names if x is not None}
        out.append((i, len(own), len(hit), len(names), ",".join(sorted(names)), bool(hit) and 20 * len(hit) >= len(own)))
    return odd.counted(out)


def test_decontamination(spark, docs, none, monkeypatch):
    source = odd.texts()
    item = lambda i, a, b: " ".join(odd.words(source[i][1])[a:b])
    items = [(1, item(7, 0, 40).upper()), (10, item(8, 3, 9)), (2, item(75, 3, 33)), (2, item(75, 3, 33)), (None, item(11, 0, 30)), (3, None), (4, "?!"), (5, item(8, 5, 9)), (6, "absent " * 20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for slice_ in (decontaminate.SLICE, 300):
        monkeypatch.setattr(decontaminate, "SLICE", slice_)
        monkeypatch.setattr(decontaminate, "SHARD", 50)
        found = decontaminate.contamination(docs, benchmark)
        rows = found.select("doc_id", "n_words", "n_hit", "n_items", F.array_join(F.array_sort("items"), ","), "contaminated").collect()
        assert odd.counted(rows) == contamination(source, items)
    cleaned = decontaminate.without(found.where("doc_id = 8 OR doc_id = 503")).collect()
    for r in cleaned:
        inside = {p for s in r.spans for p in range(s.start, s.end)}
        whole = odd.plain_words(next(t for i, t, _ in source if i == r.doc_id))
        assert odd.plain_words(r.text) == [w for p, w in enumerate(whole) if p not in inside]
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(0)
    text = np.concatenate((rng.integers(1, 5, 3000), [0]))
    index = fm_index.FmIndex(text)
    phrases = np.array([text[i : i + 6] for i in rng.integers(0, 2900, 50)] + [[9] * 6, [1] * 6])
    low, high = index.search(phrases)
    for phrase, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(len(text) - 5) if (text[i : i + 6] == phrase).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
