import random

from codeloom.llm import mixing, packing, spans, tokens

TEXT = "doc_id long, text string, bucket string, len int"


def brute_pairs(texts, span):
    seen = {}
    for i, t in texts:
        for k in range(len(t or "") - span + 1):
            seen.setdefault(t[k:k + span], set()).add(i)
    return {(a, b) for s in seen.values() for a in s for b in s if a < b}, seen


def test_shared_spans_against_brute_force(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdé \n", k=r.randint(1, 9)))
    base = ["".join(word() for _ in range(60)) for _ in range(6)]
    docs = []
    for i in range(40):
        t = "".join(word() for _ in range(r.randint(0, 30)))
        for _ in range(r.randint(0, 2)):
            b = r.choice(base)
            a = r.randrange(len(b) - 60)
            t += b[a:a + r.randint(30, 60)] + "".join(word() for _ in range(r.randint(0, 20)))
        docs.append((i, t))
    docs += [(100, "x" * 500), (101, "x" * 130), (102, "ab" * 100), (103, None), (104, ""), (105, "ba" * 60), (0, docs[0][1]), (None, "x" * 300)]
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in docs], TEXT)
    span = 40
    found = spans.shared_spans(df, span=span, anchor=20)
    pairs, seen = brute_pairs([d for d in docs if d[0] is not None], span)
    assert {tuple(x) for x in spans.shared_pairs(found).collect()} == pairs and pairs
    assert {tuple(x) for x in spans.shared_pairs(found, block=3).collect()} == pairs
    classes, members = spans.shared_classes(found)
    inside = {}
    for x in members.collect():
        inside.setdefault(x.class_id, []).append(x.doc_id)
    assert {(min(a, b), max(a, b)) for m in inside.values() for a in m for b in m if a != b} == pairs
    assert {(x.class_id, x.members, x.links) for x in classes.collect()} == {(c, len(m), len(m) * (len(m) - 1) // 2) for c, m in inside.items()}
    share = {x.doc_id: x.shared_chars for x in spans.shared_share(df, found).collect()}
    for i, t in dict(docs).items():
        if i is None:
            continue
        covered = set()
        for k in range(len(t or "") - span + 1):
            if len(seen[t[k:k + span]]) > 1:
                covered |= set(range(k, k + span))
        assert share[i] == len(covered), i


def test_one_passage_in_many_documents(spark):
    """The class is one row; its pairs are spread over blocks."""
    passage = "".join(random.Random(4).choices("abcdefgh ", k=260))
    df = spark.range(3000).selectExpr("id as doc_id", f"concat('doc ', id, '{passage}', id * 7) as text")
    classes = spans.shared_classes(spans.shared_spans(df))[0].orderBy("members", ascending=False).collect()
    assert (classes[0].members, classes[0].links) == (3000, 3000 * 2999 // 2)
    pairs = spans.shared_pairs(spans.shared_spans(df.where("doc_id < 400")), block=50)
    assert pairs.count() == 400 * 399 // 2


def test_spans_of_nothing(spark):
    empty = spark.createDataFrame([], TEXT)
    assert spans.shared_pairs(spans.shared_spans(empty)).count() == 0
    assert spans.shared_share(empty, spans.shared_spans(empty)).count() == 0


def test_plan():
    r = random.Random(2)
    for capacity in (10, 97):
        counts = {}
        for _ in range(300):
            n = r.randint(1, capacity)
            counts[n] = counts.get(n, 0) + 1
        slots, opened = packing.plan_slots(list(counts.items()), capacity)
        load, placed = [0] * opened, {}
        for length, first, number, container in slots:
            for i in range(number):
                load[container + i] += length
                placed.setdefault(length, set()).add(first + i)
        assert max(load) <= capacity and min(load) > 0
        assert {k: len(v) for k, v in placed.items()} == counts and all(v == set(range(counts[k])) for k, v in placed.items())
        assert opened <= 1.1 * -(-sum(k * v for k, v in counts.items()) // capacity) + 1
    assert packing.plan_slots([], 5) == ([], 0)


def test_containers(spark):
    texts = [(i, " ".join(["word"] * n), "c", 1) for i, n in enumerate([3, 3, 3, 40, 17, 9, 1, 1, 25])] + [(50, None, "c", 1), (51, "", "c", 1), (0, "word word word", "c", 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string, capacity string, size int")
    budgets = spark.createDataFrame([("a", 12, 2), ("b", 100, None), ("none", 5, 5), (None, 9, 0)], "budget_name string, capacity_tokens int, reserved_tokens int")
    sizes = tokens.token_sizes(df)
    want = {i: len(t.split()) for i, t, *_ in texts if t}
    assert {r.doc_id: r.tokens for r in sizes.where("tokens > 0").collect()} == want
    items = packing.placed(packing.pieces(sizes, budgets))
    boxes = packing.containers(items).collect()
    assert {b.budget_name for b in boxes} == {"a", "b"} and all(b.used_tokens <= b.capacity for b in boxes)
    for name, room in (("a", 10), ("b", 100)):
        got = {}
        for b in boxes:
            if b.budget_name == name:
                for c in b.contents:
                    got.setdefault(c.doc_id, []).append((c.part_no, c.token_from, c["size"]))
        assert {i: sum(x[2] for x in v) for i, v in got.items()} == want
        assert all(len(v) == 1 for i, v in got.items() if want[i] <= room)
    empty = packing.placed(packing.pieces(sizes.limit(0), budgets))
    assert packing.containers(empty).count() == 0


def test_mixture(spark):
    r = random.Random(4)
    vocab = {"wiki": "page link edit topic".split(), "code": "loop class call stack".split(), "rare": "ore gem dig mine".split()}
    docs = []
    for i in range(900):
        s = r.choices(["wiki", "code", "rare", None], [50, 40, 4, 6])[0]
        words = vocab[s or "code"]
        docs.append((i, " ".join(r.choices(words, k=r.randint(5, 60))), f" {s.upper()} " if s and i % 3 == 0 else s, 3))
    docs += [(1000, None, "wiki", 3), (1001, "", "wiki", 3), (1002, "a b c", "other", 3), (1003, docs[0][1], docs[0][2], 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, label int")
    targets = mixing.targets_of(spark.createDataFrame([("Wiki ", 0.4, 1), ("code", 0.4, 2), ("rare", 0.2, 3), (None, 0.3, 1)], "source string, target_share double, max_repeats int"))
    table = mixing.members(df.drop("label"), targets).cache()
    guessed = table.where("label is null").collect()
    assert guessed and sum(x.membership[0] > 0.5 for x in guessed) >= 0.9 * len(guessed)  # held-out texts without a source
    mixed = mixing.mixture(table, targets)
    rows = mixed.collect()
    assert 1002 not in {x.doc_id for x in rows} and 1003 not in {x.doc_id for x in rows}
    shares = {x.source: x for x in mixing.shares(mixed, targets).collect()}
    for s in shares.values():
        assert abs(s.reached_share - s.target_share) < 0.02 and s.most_copies <= s.max_repeats
    empty = mixing.members(df.drop("label").limit(0), targets)
    assert mixing.mixture(empty, targets).count() == 0
