"""Each operator against a plain version on small or generated data, and its corner cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from vectorscape.llm import bpe, chat, decontaminate, licenses, neardup, pii, quality, registry, shared, shards, substrings, toxicity

RANKS = P.path("byte_bpe_50k.tiktoken")
SQL = registry.oracle_sql()
#: Null, empty, long, wordless, repeated and tied rows.
ODD = [(1, None), (2, ""), (3, "a b c d e f g " * 3000), (4, "--- !!"), (5, "one two"), (6, "one two"), (6, "one two"), (7, "é ü 中 " * 20)]


def odd(spark, rows=ODD):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long"), "k": F.lit("x"), "ids": F.lit(1), "row": F.lit(2), "_n": F.lit(3)})


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    same(registry.queries()[name](spark, sf), SQL[name], sf)


# 1


def test_store(spark, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=60_000, fan=3)
    with pytest.raises(ValueError):
        store.read()
    df = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    for k in range(5):
        store.append(df.filter(F.col("id") % 5 == k).coalesce(2))
    before = store.manifest()
    after = store.compact()
    assert len(store.shards(after)) < len(store.shards(before)) and store.read().exceptAll(df).count() == 0 and store.read().count() == 3000
    assert store.read(before["version"]).count() == 3000
    with pytest.raises(RuntimeError):
        store.commit(before, df.schema, [])
    store.vacuum()
    assert store.versions() == [after["version"]] and store.read().count() == 3000
    store.append(df.limit(0))
    assert store.read().count() == 3000
    odd_store = shards.shard([odd(spark)], str(tmp_path / "o"))
    assert odd_store.read().exceptAll(odd(spark)).count() == 0


def test_store_schemas(spark, tmp_path):
    """An append may lack columns or bring new ones; nothing is lost by it, nor by compaction; other types commit nothing."""
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=100_000, fan=2)
    store.append(spark.createDataFrame([(1, "a")], "id long, x string"))
    store.append(spark.createDataFrame([(2,)], "id long"))
    store.append(spark.createDataFrame([(2.5, 3)], "y double, id long"))
    want = [(1, "a", None), (2, None, None), (3, None, 2.5)]
    assert store.read().columns == ["id", "x", "y"] and sorted(map(tuple, store.read().collect())) == want
    version = store.manifest()["version"]
    for bad in ("id string", "ID long"):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame([], bad))
    assert store.manifest()["version"] == version
    store.compact()
    store.vacuum()
    assert sorted(map(tuple, store.read().collect())) == want


def test_files_arrive_in_turn(spark, tmp_path):
    for n_files in (1, 7):
        rows = spark.range(100).selectExpr("id AS doc_id", "cast(id AS string) AS text").repartition(n_files)
        rows.write.parquet(str(tmp_path / f"{n_files}" / "t.parquet"))
        parts = shards.by_files(spark, str(tmp_path / f"{n_files}"), "t", 3)
        assert len(parts) == min(3, n_files) and sorted(r.doc_id for p in parts for r in p.collect()) == list(range(100))
        store = shards.shard(parts, str(tmp_path / f"s{n_files}"), fan=2)
        assert sorted(r.doc_id for r in store.read().collect()) == list(range(100)) and len(store.shards(store.manifest())) < 7


def test_store_lists(spark, tmp_path, monkeypatch):
    """Short lists are put together; a tier that doesn't pack stays, and doesn't keep others from packing."""
    monkeypatch.setattr(shards, "SHORT_LISTS", 3)
    store = shards.ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fan=2)
    for k in range(8):
        store.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    m = store.manifest()
    assert len(m["lists"]) <= 3 and sum(x["shards"] for x in m["lists"]) == len(store.shards(m)) == 8
    assert store.read(3).count() == 30
    after = store.compact()
    assert len(store.shards(after)) < 8 and sorted(r.id for r in store.read().collect()) == list(range(80))
    store.vacuum(2)
    assert len(store.versions()) == 2 and store.read().count() == store.read(store.versions()[0]).count() == 80


# 2


def test_bpe_equals_library():
    tree, enc = bpe.Tree(RANKS, leaf=5, window=2), bpe.codec(RANKS, P.PATTERN)
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("ab  \n\n'slré \x1c\x85 \t\r0189.,!中ü") for _ in range(r.randint(0, 80)))
        ids = tree.encode(t)
        assert ids == enc.encode_ordinary(t) and tree.decode(ids) == t.encode()


def test_bpe_tables(spark):
    docs = odd(spark)
    got = bpe.encode_digests(docs, RANKS).collect()
    enc = bpe.codec(RANKS, P.PATTERN)
    want = sorted((i, len(ids := enc.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD)
    assert sorted(map(tuple, got)) == want
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted((r.doc_id, bytes(r.bytes)) for r in back) == sorted((i, (t or "").encode()) for i, t in ODD)
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


# 3


def test_events_fold(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "Hel"), (1, 1, 3, "delta", None, "lo"), (1, 1, 3, "delta", None, "lo"),
        (1, 0, 4, "edit", None, "hey"), (1, 1, 5, "regenerate", None, "Yo"), (1, 1, 6, "delta", None, "!"), (1, 2, 7, "message", "user", "bye"), (1, 2, 8, "delete", None, None),
        (2, 0, 0, None, None, None), (None, 0, 0, "message", "user", "x"),
    ]
    events = spark.createDataFrame(rows, "conv_id long, msg long, seq long, kind string, role string, text string")
    got = sorted((r.conv_id or 0, r.position, r.role, r.text) for r in chat.reconstruct(events).collect())
    assert got == [(0, 0, "user", "x"), (1, 0, "user", "hey"), (1, 1, "assistant", "Yo!"), (2, 0, "", "")]
    assert chat.digests(chat.render(chat.reconstruct(events.limit(0)))).count() == 0


def test_any_text_reads_back(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "/", "s>", "INST]", "\n", "é"]) for _ in range(r.randint(0, 12))) for _ in range(400)]
    m = spark.createDataFrame([(i, 0, 0, t[:5], t) for i, t in enumerate(texts)], "conv_id long, position long, msg long, role string, text string")
    for row in chat.render(m).collect():
        role, text = map(chat.unescape, chat._SEGMENT.fullmatch(row.segment).groups())
        assert (role, text) == (texts[row.conv_id][:5], texts[row.conv_id])


def test_each_row_is_a_turn(spark, tmp_path):
    """Tied, repeated and null turns against the SQL; its order says nothing about ties of different rows, so digests are compared where order doesn't count."""
    rows = [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (1, None, "user", "last"),
        (2, None, "assistant", "a"), (2, None, "assistant", "a"), (2, 5, "user", "first"), (3, None, None, None), (3, None, None, None),
        (None, 0, "user", "x"), (None, 0, "user", "x"), (4, 0, "user", "b"), (4, 0, "assistant", "c"), (4, 0, "user", "a"), (4, 0, "assistant", "</s>"), (4, None, "user", "z"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    tied = "coalesce(conv_id, 0) = 4"
    got = chat.op3_chat(spark, str(tmp_path))
    same(got.filter(f"NOT ({tied})"), f"SELECT * FROM ({SQL['op3_chat']}) WHERE NOT ({tied})", str(tmp_path))
    counts = "conv_id, n_turns, loss_chars, formatted_chars"
    same(got.select(*counts.split(", ")), f"SELECT {counts} FROM ({SQL['op3_chat']})", str(tmp_path))
    turns = "assistant\n</s>\nassistant\nc\nuser\na\nuser\nb\nuser\nz\n"
    assert got.filter(tied).first().turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()


# 4


def repeat_words(words):
    seen = defaultdict(list)
    for i in range(len(words) - 4):
        seen[tuple(words[i : i + 5])].append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)})


def test_quality_counts(spark):
    r = random.Random(3)
    rows = [(100 + i, " ".join(r.choice("abc") for _ in range(r.randint(0, 40))) + r.choice(["", "\nx y\nx y\n\n \nx y", "#|<"])) for i in range(60)] + ODD
    for got in quality.text_counts(odd(spark, rows)).collect():
        t = dict(rows)[got.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat_words(w))


def test_hosts(spark):
    rows = [("bad", True)] * 90 + [("bad", False)] * 10 + [("good", False)] * 100 + [("tiny", True)] + [(None, False)]
    got = {r.host: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert got["bad"].rejected and not got["good"].rejected and got["tiny"].shrunk_rate < 1 and None in got
    assert quality.judge(odd(spark).limit(0)).count() == 0 and quality.judge(odd(spark)).count() == len(ODD)


def test_one_failure_rejects_no_host(spark):
    """Hosts of one document each, 30 % of which fail: the spread of their rates is sampling noise alone."""
    rows = [(f"h{i}", i % 10 < 3) for i in range(500)]
    got = quality.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()
    assert not any(r.rejected for r in got)
    rows += [("bad", True)] * 400 + [("good", False)] * 600
    got = {r.host: r.rejected for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert [h for h, x in got.items() if x] == ["bad"]


# 5


def brute_spans(t):
    digits = pii.only_digits
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15])


def test_base_spans():
    r = random.Random(4)
    for alphabet in ("a.@-b1 ", "0123456789.. ", "01 -8642973", "+12 ().34-5678", "a@b.c1+2.-3 é"):
        for _ in range(2000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            assert pii.base_spans(t) == brute_spans(t), t


def test_pii_query(spark, sf):
    """All columns of the query over a whole table, against plain patterns; terms aside, which tests of their own cover."""
    found = {r.doc_id: r for r in registry.queries()["op5_pii"](spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in shared.table(spark, sf, "documents").select("doc_id", "text").collect()}
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        want, r = brute_spans(t), found[i]
        names = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in want) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("term:")] == names
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in found.values()) > 10


def test_disclosing_terms(spark):
    rows = [(i, f"filler{i} note{i} nightowl met ann@x.org {'abc' * (i + 1)} end{i}") for i in range(6)] + [(50 + i, f"other{i} met someone end{i}") for i in range(400)] + [(900, None), (901, "")]
    docs = odd(spark, rows)
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert {rows[0][1][x.start : x.end] for x in spans[0]} == {"nightowl", "ann@x.org"} and spans[60] == [] and spans[900] == []
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "nightowl" not in clean[0] and "<EMAIL>" in clean[0] and clean[60] == rows[16][1] and clean[900] is None
    assert {r.doc_id: r.text for r in pii.sanitise(docs.dropDuplicates(["doc_id"]), send=0).collect()} == clean
    assert pii.sanitise(docs).columns == docs.columns and pii.find(docs.limit(0)).count() == 0


def test_rare_entities_disclose(spark):
    """Names beside an entity that is seen once or twice; copies of a text change nothing, frequent words are no names."""
    once, twice = "met with zebrafinch bob@y.org someone end1", ["someone met quokka eve@z.org end2", "with quokka eve@z.org met someone end3"]
    others = [(1000 + i, f"note{i} met with someone end{i % 4}") for i in range(1500)]
    named = {700: {"zebrafinch"}, 701: {"quokka"}, 702: {"quokka"}}
    for copies in (1, 3):
        docs = odd(spark, [*others, *[(700, once)] * copies, *[(701, twice[0])] * copies, *[(702, twice[1])] * copies, (None, once), (None, "plain")])
        text = {700: once, 701: twice[0], 702: twice[1]}
        rows = pii.find(docs).collect()
        for r in rows:
            if r.doc_id in named:
                assert {text[r.doc_id][x.start : x.end] for x in r.spans if x.kind == 4} == named[r.doc_id]
        assert sum(len(r.spans) for r in rows if r.doc_id not in named and r.doc_id is not None) == 0
        clean = sorted((r.doc_id or 0, r.text) for r in pii.sanitise(docs).collect())
        assert len(clean) == docs.count() and not any(n in t for _, t in clean for n in ("zebrafinch", "quokka", "@"))
        assert sorted((r.doc_id or 0, r.text) for r in pii.sanitise(docs, send=0).collect()) == clean


def test_copies_change_no_degree(spark):
    """A name that also stands out of reach of its entity: however often its text is copied, the degrees are the same."""
    far = " ".join(f"pad{i}" for i in range(12))
    texts = [f"quokka met ann@x.org and {far} quokka again", f"gecko gecko met bob@x.org {far}", *[f"note{i} met with someone" for i in range(900)]]
    seen = []
    for copies in (1, 6):
        docs = odd(spark, [(i, t) for i, t in enumerate(texts) for _ in range(copies if i < 2 else 1)])
        base = pii.find_base(docs, "doc_id", "text", pii.REACH)
        assert all(r.n_words == len(decontaminate.word_list(texts[r.doc_id])) for r in base.collect())
        degrees = pii.disclosures(docs, base, generalise_at=0.0, send=1000)
        assert sorted(map(tuple, pii.disclosures(docs, base, generalise_at=0.0, send=2).collect())) == sorted(map(tuple, degrees.collect()))
        seen.append(sorted(tuple(r) for r in degrees.collect()))
    assert seen[0] == seen[1] and len(seen[0]) > 4


def test_degrees_by_hand(spark):
    """n(e, t), n(t) and IC(e) counted plainly over different texts."""
    r = random.Random(14)
    mails = ["ann@x.org", "bob@y.org"]
    texts = [" ".join(r.choice([*mails, *"alpha beta gamma delta epsilon zeta".split(), *(f"w{k}x" for k in range(60))]) for _ in range(r.randint(1, 60))) for _ in range(80)]
    docs = odd(spark, [(i, t) for i, t in enumerate(texts + texts[:30])])
    near, both, total, mentions = defaultdict(set), Counter(), Counter(), Counter()
    for t in sorted(set(texts)):
        tokens = [(m.group(), m.start()) for m in re.finditer(r"[a-z0-9@.]+", t)]
        plain = [w for w, _ in tokens]
        total.update(x for w in plain for x in re.findall("[a-z0-9]+", w))
        around, contexts = defaultdict(dict), {}
        spans = [k for k, w in enumerate(plain) if "@" in w]
        pieces = [(x, k) for k, w in enumerate(plain) for x in re.findall("[a-z0-9]+", w)]
        for k in spans:
            mentions[plain[k]] += 1
            before, after = [p for p in pieces if p[1] < k][-8:], [p for p in pieces if p[1] > k][:8]
            contexts[k] = " ".join(x for x, _ in before + after)
            first = next(i for i, p in enumerate(pieces) if p[1] == k)
            for i, (x, at) in [*list(enumerate(pieces))[max(0, first - 8) : first], *list(enumerate(pieces))[first + 3 : first + 11]]:
                if len(x) >= 3 and "@" not in plain[at]:
                    around[plain[k]].setdefault(i, (x, contexts[k]))
        for e, of in around.items():
            for x, context in of.values():
                both[e, context, x] += 1
    n_both, again = Counter((e, x) for e, _, x in both), Counter()
    for (e, _, x), n in both.items():
        again[e, x] += n
    want = {}
    for (e, x), n in n_both.items():
        content = -np.log2(min(0.5, mentions[e] / sum(total.values())))
        want[pii.stable(f"email:{e}"), int(pii.hashes_of([x])[0])] = 1 + np.log2(min(1.0, n / (total[x] - again[e, x] + n + pii.PRIOR))) / content
    got = {(r.entity, r.term): r.degree for r in pii.disclosures(docs, pii.find_base(docs, "doc_id", "text", pii.REACH), generalise_at=-9.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_overlaps():
    r = random.Random(9)
    for _ in range(300):
        spans = sorted((s := r.randint(0, 40), 0, s + r.randint(1, 12)) for _ in range(r.randint(0, 6)))
        inside = pii.overlaps(spans)
        assert all(inside(s, s + n) == any(a < s + n and s < b for a, _, b in spans) for s in range(50) for n in (1, 4))


# 6


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_automaton_and_sieve():
    entries = [toxicity.Entry("idiot", False), toxicity.Entry("disgusting", False), toxicity.Entry("lowei", True), toxicity.Entry("ababaabab", True), toxicity.Entry("réeuxé", True)]
    lexicon, r, words = toxicity.Lexicon(entries), random.Random(5), []
    for _ in range(3000):
        w = list(r.choice(entries).text)
        for _ in range(r.randint(0, 3)):
            p = r.randrange(len(w) + 1)
            w[p : p + r.randint(0, 1)] = r.choice(["", "i", "x", "é", "ab"])
        w = "".join(w) + r.choice(["", "abc"])
        if len(w) < 2:
            continue
        words.append(w)
        want = set()
        for e in entries:
            d = min(distance(e.text, w[:i]) for i in range(len(w) + 1)) if e.stem else distance(e.text, w)
            if d <= e.distance:
                want.add((e, d))
        assert set(lexicon.match(w)) == want, w
    data, offsets = shared.utf8(pa.array(words))
    starts, ends, _, _ = shared.words(data, offsets)
    assert not [w for w, x in zip(words, lexicon.possible(data, starts, ends)) if not x and lexicon.match(w)]


def test_toxicity_learns(spark):
    rows = [(i, f"you {'moron' if i % 5 == 0 else 'friend'} number{i} walk{i % 7} home{i % 3}") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows if i % 2 == 0] + [(7, None)], "doc_id long, toxic int")
    docs = odd(spark, [*rows, (500, None), (501, ""), (502, "what a morron"), (503, "he said “moron” twice")])
    model = toxicity.learn(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((score[i] >= 0.5) == (i % 5 == 0) for i, _ in rows)
    assert score[502] >= 0.5 and score[503] < 0.5 and score[500] == score[501] == model.none < 0.5
    assert toxicity.reject(docs, model).columns == docs.columns and toxicity.reject(docs, model).count() == 163
    none = toxicity.learn(docs, labels.limit(0))
    assert none.entries == [] and toxicity.score(docs, none).count() == docs.count()


def test_rare_terms_are_learned():
    """A precise term in few of many toxic rows is an entry, one that chance explains isn't, whatever the sample."""
    for n_toxic, n_clean in ((500, 4000), (2000, 18_000)):
        nodes = {"zorg": (60, 60), "blip": (9, 9), "half": (60, 60)}
        toxic, clean = Counter(zorg=60, blip=9, half=60), Counter(half=300)
        assert [e.text for e in toxicity.choose_entries(nodes, toxic, clean, n_toxic, n_clean, 0.8)] == ["zorg"]


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    scored = toxicity.score(shared.table(spark, sf, "documents"), toxicity.learn(shared.table(spark, sf, "documents"), toxicity.learning_rows(shared.table(spark, sf, "labels"))))
    rows = scored.join(shared.table(spark, sf, "labels"), "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    hit = sum((r.score >= 0.5) and r.toxic == 1 for r in rows)
    assert hit / sum(r.toxic == 1 for r in rows) > 0.85 and hit / sum(r.score >= 0.5 for r in rows) > 0.9


# 7


def brute_join(rows):
    sets = {}
    for _, t in rows:
        w = decontaminate.word_list(t)
        sets[t or ""] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    link = {a: {b for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8} for a in sets}
    root = {}
    for t in sets:
        if t in root:
            continue
        seen, todo = {t}, [t]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        smallest = min(i for i, x in rows if (x or "") in seen)
        root |= dict.fromkeys(seen, smallest)
    return sorted({(i, root[t or ""], len(link[t or ""])) for i, t in rows})


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_join(spark, monkeypatch, small_blocks):
    """With small blocks the runs of the tries are cut, met again and verified block by block; hot keys are sent."""
    r = random.Random(6)
    rows = list(ODD)
    for g in range(12):
        base = [r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(1, 90))]
        for k in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = "zz"
            rows.append((100 * (g + 1) + k, " ".join(w)))
    if small_blocks:
        monkeypatch.setattr(neardup, "BLOCK_SIGNATURES", 3)
        monkeypatch.setattr(neardup, "BLOCK_BYTES", 500)
        monkeypatch.setattr(shared, "HOT_ROWS", 2)
    got = neardup.near_join(odd(spark, rows), send=5 if small_blocks else 1000)
    assert sorted({tuple(x) for x in got.collect()}) == brute_join(rows)
    kept = [x.doc_id for x in neardup.keep_one(odd(spark, rows)).collect()]
    assert sorted(set(kept)) == sorted({c for _, c, _ in brute_join(rows)})
    assert neardup.near_join(odd(spark).limit(0)).count() == 0


def test_near_join_repeated_smallest_key(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (1, a), (2, a + " x"), (3, b), (3, "other words altogether"), (4, b + " y"), (5, b + " z")]
    got = sorted(tuple(r) for r in neardup.near_join(odd(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 3, 0), (3, 3, 2), (4, 3, 2), (5, 3, 2)]


def test_near_join_names_and_keys(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text + " x"), (3, "else"), (None, text), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"copy": F.lit(1), "Copy2": F.lit(2), "k": F.lit(3), "_copy": F.lit(4), "class_id": F.lit(5)})
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, text), (1, text), (3, "else")]
    with pytest.raises(ValueError):
        neardup.near_join(docs.withColumn("doc_id", F.lit("a")))


def test_forest():
    """Runs are joined where signatures agree, at any depth down to the last, and nowhere else."""
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 16, (6, 64)).astype(np.uint16)
    sig = base[r.integers(0, 6, 200)]
    sig[r.random(sig.shape) < 0.08] = 7
    bucket, label = np.repeat([1, 2], 100), r.integers(0, 2, (200, 8)).astype(np.uint16)
    label[:, :3] = 5
    order = np.lexsort((*label.T[::-1], bucket))
    sig, label, bucket = sig[order], label[order], bucket[order]
    root = neardup.shortened(bucket, label, sig, 3, 40)
    want = np.arange(200)
    for _ in range(200):
        for i in range(200):
            near = (bucket == bucket[i]) & ((sig == sig[i]).sum(1) >= 40)
            want[near] = want[near].min()
    assert all(len({w for w, x in zip(want, root) if x == y}) == 1 for y in set(root.tolist())) and len(set(root.tolist())) == len(set(want.tolist()))


def test_last_depth():
    d = neardup.last_depth(0.8, 32, 0.9999)
    assert 1 - (1 - 0.8**d) ** 32 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 32


# 8


def brute_repeats(texts, length, keep_first=False):
    at = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            at[t[i : i + length]].append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in at.values():
        if len(places) > 1:
            for d, i in sorted(places)[1 if keep_first else 0 :]:
                gone[d][i : i + length] = b"\1" * length
    return [bytes(b for b, g in zip(t, x) if not g) for t, x in zip(texts, gone)]


@pytest.mark.parametrize(("group", "keep_first"), [(256, False), (2, False), (256, True), (2, True)])
def test_repeats(spark, group, keep_first):
    r = random.Random(7)
    for alphabet in ("ab", "abcdefg é"):
        base = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 150))) for _ in range(10)]
        texts = ["".join(r.choice([r.choice(base), "xyz " * r.randint(0, 20)]) for _ in range(r.randint(0, 4))) for _ in range(40)]
        texts = [t[: len(t) // 2] + r.choice(["", "#"]) + t[len(t) // 2 :] for t in texts] + texts[:3] + [""]
        docs = odd(spark, [*enumerate(texts), (999, None)])
        got = {x.doc_id: x for x in substrings.remove_repeats(docs, length=40, anchor=13, group=group, keep_first=keep_first, send=1 if group == 2 else 1 << 20).collect()}
        want = brute_repeats([t.encode() for t in texts], 40, keep_first)
        assert [bytes(got[i].kept) for i in range(len(texts))] == want and bytes(got[999].kept) == b""
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_large_group_of_repeats(spark):
    """A passage in many texts, whose contexts make groups far above ``group``, cut differently in each."""
    r = random.Random(12)
    passage = "".join(r.choice("abcdefgh") for _ in range(70))
    texts = ["".join(r.choice("xyz") for _ in range(r.randint(0, 40))) + passage[r.choice([0, 0, 7]) : r.choice([70, 70, 55])] + "".join(r.choice("xyz") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for keep_first in (False, True):
        got = {x.doc_id: bytes(x.kept) for x in substrings.remove_repeats(docs, length=40, anchor=13, group=16, keep_first=keep_first).collect()}
        assert [got[i] for i in range(len(texts))] == brute_repeats([t.encode() for t in texts], 40, keep_first)


def test_factors():
    r = np.random.default_rng(8)
    data = r.integers(97, 100, 120).astype(np.uint8)
    text = data.tobytes()
    places = np.arange(len(text) - 20)
    previous, following = substrings.factors(data, places, places, 20)

    def common(i, j):
        k = 0
        while k < 20 and text[i + k] == text[j + k]:
            k += 1
        return k

    for i in places.tolist():
        assert previous[i] == max((common(i, j) for j in range(i)), default=0)
        assert following[i] == max((common(i, j) for j in range(i + 1, len(places))), default=0)


# 9


def test_decontaminate_corners(spark):
    bench = spark.createDataFrame([(1, "One two"), (2, None), (3, "..."), (4, "a b c d e f g h i j k"), (5, "one TWO"), (6, "z")], "item_id long, text string")
    docs = odd(spark, [*ODD, (20, "x one, two y"), (21, "a b c d e f g h i j"), (22, "b c d e f g h i j"), (23, "Z z")])
    for blocks in (1 << 20, 8):
        r = {x.doc_id: x for x in decontaminate.contamination(docs.dropDuplicates(["doc_id"]), bench, block_bytes=blocks).collect()}
        assert (r[20].n_hit, r[20].items) == (2, ["1", "5"]) and (r[21].n_hit, r[21].items, r[22].n_hit, r[23].n_hit) == (10, ["4"], 0, 2)
        assert r[1].n_words == r[2].n_words == r[4].n_words == 0 and not r[1].contaminated
    left = decontaminate.remove(docs, bench)
    assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == {1, 2, 3, 4, 7, 22}
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_decontaminate_null_and_repeated_keys(spark):
    bench = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, "five six"), (4, "z")], "item_id long, text string")
    rows = [(None, "one two"), (None, "clean"), (None, "three four z"), (None, "clean too"), (None, None), (7, "five six"), (7, "clean"), (7, "clean"), (8, "z one two")]
    docs = odd(spark, rows)
    want = sorted([(0, 0, 0), (0, 1, 0), (0, 2, 0), (0, 2, 1), (0, 3, 2), (7, 1, 0), (7, 1, 0), (7, 2, 1), (8, 3, 2)])
    for blocks in (1 << 20, 16, 8):
        got = decontaminate.contamination(docs, bench, block_bytes=blocks).collect()
        assert sorted((r.doc_id or 0, r.n_words, len(r["items"])) for r in got) == want
        assert all(r.contaminated == (len(r["items"]) > 0) for r in got)
        left = decontaminate.remove(docs, bench, block_bytes=blocks)
        assert left.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (0, "clean"), (0, "clean too"), (7, "clean"), (7, "clean")]


def test_decontaminate_one_word_item_begins_another(spark):
    bench = spark.createDataFrame([(1, "z"), (2, "z a"), (3, "z a b"), (4, "q r s t")], "item_id long, text string")
    docs = odd(spark, [(1, "x z a"), (2, "b c z a"), (3, "b q r s"), (4, "y z a b"), (5, "y y z a")]).coalesce(1)
    r = {x.doc_id: (x.n_hit, x.items) for x in decontaminate.contamination(docs, bench).collect()}
    assert r == {1: (2, ["1", "2"]), 2: (2, ["1", "2"]), 3: (0, []), 4: (3, ["1", "2", "3"]), 5: (2, ["1", "2"])}


# 10


def test_licenses_equal_brute_force(spark, sf):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall() + [(-1, "MIT  License, the mit-license; General Public License mit license")]
    find = licenses.automaton()
    for _, t in rows:
        w = [x.decode() for x in decontaminate.word_list(t)]
        places = [k for p in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        got = licenses.scan(t, find, licenses.NOTICES)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))


def test_expressions(spark):
    assert licenses.to_postfix("(MIT OR GPL-2.0 WITH Classpath-exception-2.0) AND BSD") == ["MIT", "GPL-2.0", "Classpath-exception-2.0", "WITH", "OR", "BSD", "AND"]
    assert licenses.evaluate_text("MIT AND GPL-3.0")[0] == licenses.freedom("gpl") and licenses.evaluate_text("MIT OR GPL-3.0")[0] == licenses.freedom("mit")
    assert licenses.evaluate_text("MIT OR (")[1] == ["MIT"] and licenses.evaluate_text("AND")[0] == 0.0
    docs = odd(spark, [*ODD, (20, "// SPDX-License-Identifier: Apache-2.0 OR MIT\ncode")])
    r = {x.doc_id: x for x in licenses.scan_licenses(docs).collect()}
    assert r[20].licences == ["Apache-2.0", "MIT"] and r[20].score == 0.95 and r[1].score == 0.0 and licenses.scan_licenses(docs.limit(0)).count() == 0


# Queries without SQL: every column over a whole table


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in shared.table(spark, sf, "documents").select("doc_id", "text").collect()}


def by_id(spark, sf, name):
    rows = registry.queries()[name](spark, sf).collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_bpe_query(spark, sf, texts):
    found, enc = by_id(spark, sf, "op2_bpe"), bpe.codec(RANKS, P.PATTERN)
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t))


def test_repeats_query(spark, sf, texts):
    found, names = by_id(spark, sf, "op8_repeats"), sorted(texts)
    assert found.keys() == texts.keys()
    raw = [texts[i].encode() for i in names]
    seen = Counter(hash(t[k : k + 400]) for t in raw for k in range(len(t) - 399))
    for i, t in zip(names, raw):
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - 399):
            if seen[hash(t[k : k + 400])] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        lost = np.cumsum(gone)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], lost.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~lost])
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(lost.sum()), spans, sha(kept))
    assert sum(r.n_removed > 0 for r in found.values()) > 5


def test_license_query(spark, sf, texts):
    found = by_id(spark, sf, "op10_licenses")
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        w, r = [x.decode() for x in decontaminate.word_list(t)], found[i]
        hits = [(k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places, labels = [k for k, _ in hits], sorted({x for _, x in hits})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(labels))
        named = [x for x in r.labels.split(",") if x]
        assert named == sorted(set(named)) and set(labels) <= set(named) and 0 <= r.score <= 1 and (r.score == 0 or named)


def test_toxicity_query(spark, sf, texts):
    found = by_id(spark, sf, "op6_toxicity")
    assert found.keys() == texts.keys()
    docs = shared.table(spark, sf, "documents")
    model = toxicity.learn(docs, toxicity.learning_rows(shared.table(spark, sf, "labels")))
    scanner = toxicity.Scanner(toxicity.Lexicon(model.entries))
    for i, t in texts.items():
        r = found[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
        assert r.score == model.score(scanner.classes(pa.array([t]))[0])
