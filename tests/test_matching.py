import random

from pyspark.sql import functions as F

from worktally.functions import similarity as S
from worktally.operators import matching as MA


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], max(row[j], row[j - 1], prev + 1 if x == y else 0)
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a, b):
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    windows = lambda s, t: [t[max(i, 0):i + len(s)] for i in range(1 - len(s), len(t))]
    best = max((ratio(a, w) for w in windows(a, b)), default=0.0)
    return max([best] + ([ratio(b, w) for w in windows(b, a)] if len(a) == len(b) else []))


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6))) for _ in range(n))


def test_ratios_equal_brute_force():
    rnd = random.Random(1)
    names = [words(rnd, rnd.randint(1, 3)) for _ in range(80)] + ["x" * 70 + "abc", "abc" * 40]
    block = S.Texts(names)
    for a in names[:25] + names[-2:]:
        assert [round(v, 9) for v in block.ratio(a)] == [round(ratio(a, b), 9) for b in names]
        assert all(abs(S.partial_ratio(a, b) - partial(a, b)) < 1e-9 for b in names[:30])


def score(name, full, clean):
    best = max(ratio(S.token_sorted(name), S.token_sorted(full.lower())),
               ratio(S.token_sorted(name), S.token_sorted(clean.lower())) if clean else 0.0)
    return max(best, 0.9 * partial(name, full.lower()))


def test_best_few_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(MA, "PROBE_BLOCK", 7)
    monkeypatch.setattr(MA, "ROSTER_BLOCK", 11)
    rnd = random.Random(2)
    people = [(i, words(rnd, 2).title()) for i in range(40)]
    probes = [(i, words(rnd, 2)) for i in range(20)]
    roster = spark.createDataFrame(people, "employee_id long, full_name string")
    got = {r["name"]: [(x.employee_id, round(x.score, 9)) for x in r["ranked"]]
           for r in MA.similar(spark.createDataFrame(probes, "probe_id long, name string"), roster).collect()}
    assert len(got) == len({p[1] for p in probes})
    for name, ranked in got.items():
        want = sorted(((-round(score(name, f, f), 9), i) for i, f in people))[:6]
        assert ranked == [(i, -s) for s, i in want]


def test_containment_equals_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    some = lambda: " ".join(rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 7, 9])))
    people, probes = [(i, some()) for i in range(60)], [(i, some()) for i in range(80)]
    got = {r.probe_id: (r.employee_id, r.confidence, r.method) for r in MA.contained(
        spark.createDataFrame(probes, "probe_id long, name string"),
        spark.createDataFrame(people, "employee_id long, full_name string")).collect()}
    want = {}
    for pid, name in probes:
        a = set(name.split())
        for eid, full in people:
            b = set(full.split())
            if a <= b:
                want[pid] = (eid, round(min(.95, .7 + .05 * len(a)), 4), "PARTIAL_SUBSET")
            elif b <= a:
                want[pid] = (eid, round(min(.90, .65 + .05 * len(b)), 4), "PARTIAL_SUPERSET")
            if pid in want:
                break
    assert got == want


def test_tiers_in_order(spark):
    roster = spark.createDataFrame([(1, "Ana Lopez", "a@x"), (2, "Bharath Muddada", "b@x"), (3, "Chloe Ito", None)],
                                   "employee_id long, full_name string, email string")
    probes = spark.createDataFrame([(1, "ANA LOPEZ"), (2, "Bharath"), (3, "Chloe Itoo"), (4, "B@X"), (5, "Timesheet 2024"), (6, "")],
                                   "probe_id long, name string")
    out = {r.probe_id: r for r in MA.decide(probes, MA.match(probes, roster)).collect()}
    assert (out[1].method, out[1].match_status) == ("EXACT", "AUTO_MATCHED")
    assert (out[2].method, out[2].employee_id, out[2].match_status) == ("PARTIAL_SUBSET", 2, "NEEDS_REVIEW")
    assert (out[3].method, out[3].employee_id, out[3].match_status) == ("FUZZY", 3, "AUTO_MATCHED")
    assert out[4].method == "EMAIL_EXACT" and out[5].method == "EMPTY_AFTER_CLEAN" and out[6].method == "NO_NAME"


def test_sender_by_name(spark):
    roster = spark.createDataFrame([(1, "Ana Lopez", "a@x")], "employee_id long, full_name string, email string")
    m = spark.createDataFrame([("m1", "A", "a@x"), ("m2", "Ana Lopes", "q@x"), ("m3", "Zed", "z@x"), ("m4", "", "y@x")],
                              "message_id string, sender_name string, sender_email string")
    got = {r.message_id: (r.employee_id, r.how) for r in MA.match_sender(m, roster).collect()}
    assert got == {"m1": (1, "EMAIL"), "m2": (1, "NAME")}


def test_no_cross_join_in_tiers(spark):
    roster = spark.range(2000).select(F.col("id").alias("employee_id"), F.concat(F.lit("n"), "id").alias("full_name"), F.lit(None).cast("string").alias("email"))
    probes = spark.range(2000).select(F.col("id").alias("probe_id"), F.concat(F.lit("n"), "id").alias("name"))
    plan = MA.match(probes, roster, fuzzy=False)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nothing_left_for_the_similarity_tier(spark):
    roster = spark.createDataFrame([(1, "Ana Lopez", "ana@mail.test")], "employee_id long, full_name string, email string")
    probes = spark.createDataFrame([(7, "ana lopez")], "probe_id long, name string")
    assert [(r.probe_id, r.employee_id, r.method) for r in MA.match(probes, roster).collect()] == [(7, 1, "EXACT")]
    assert MA.similar(probes.limit(0), roster).count() == 0
    assert MA.similar(probes, roster.limit(0)).count() == 0


def test_hot_words_and_long_names_in_one_path(spark):
    """A word that most names hold forms no pairs for sets with a rarer one, nor for the word alone."""
    rnd = random.Random(8)
    people = [(i, f"ana w{i % 90} x{i // 90}") for i in range(900)] + [(900, "solo"), (901, " ".join(f"l{k}" for k in range(30)))]
    probes = [(i, rnd.choice(["ana", f"w{i} ana", f"zz ana x{i % 10} w{i}", "solo ana", "nobody", f"{people[-1][1]} more", "l3 l29 l7"])) for i in range(120)]
    got = {r.probe_id: (r.employee_id, r.method) for r in MA.contained(
        spark.createDataFrame(probes, "probe_id long, name string"), spark.createDataFrame(people, "employee_id long, full_name string")).collect()}
    want = {}
    for pid, name in probes:
        a = set(name.split())
        for eid, full in people:
            b = set(full.split())
            if a <= b or b <= a:
                want[pid] = (eid, "PARTIAL_SUBSET" if a <= b else "PARTIAL_SUPERSET")
                break
    assert got == want and len(set(want.values())) > 5


def test_alternatives_stay_with_a_match(spark):
    roster = spark.createDataFrame([(1, "Ana Lopez", "a@x"), (2, "Ana Lopes", "b@x"), (3, "Anna Lopezz", None), (4, "Zed Quill", None)],
                                   "employee_id long, full_name string, email string")
    probes = spark.createDataFrame([(1, "Anna Lopez"), (2, "Zed Quill")], "probe_id long, name string")
    out = {r.probe_id: r for r in MA.decide(probes, MA.match(probes, roster)).collect()}
    assert out[1].method == "FUZZY" and {a.employee_id for a in out[1].alternatives} == {1, 2, 3} - {out[1].employee_id}
    assert [a.score for a in out[1].alternatives] == sorted((a.score for a in out[1].alternatives), reverse=True)
    assert out[2].method == "EXACT" and out[2].alternatives is None


def test_few_pairs_are_compared_and_none_is_lost(monkeypatch):
    """Of names with one letter changed only blocks and rows whose bound reaches the floor are looked at; the best few stay exact."""
    rnd = random.Random(6)
    full = [f"{rnd.choice(['Ana', 'Boris', 'Chloe', 'Dmitri'])} {rnd.choice(['Lopez', 'Smith', 'Okafor'])} {rnd.randint(100, 999)}" for _ in range(400)] + ["y" * 70, "Ana Zed"]
    names = [f[:2].lower() + f[3:].lower() for f in full[::40]] + ["ana lopez 1", "x" * 65 + " ana", "zed ana"]
    seen = []
    monkeypatch.setattr(S, "pairs_lcs", lambda a, at, *x, f=S.pairs_lcs: seen.append(len(at)) or f(a, at, *x))
    block = S.Roster(range(len(full)), full, full, 0.9)
    got = {}
    floors = [-1.0] * len(names)
    at, _, value = block.best(S.Names(names), 6, floors, windows=False)
    floors = [min(v for i, v in zip(at, value) if i == k) for k in range(len(names))]
    whole = max(seen)
    seen.clear()
    for i, who, v in zip(*block.best(S.Names(names), 6, floors)):
        got.setdefault(names[i], []).append((-round(float(v), 9), int(who)))
    for name in names:
        assert got[name] == sorted((-round(score(name, f, f), 9), i) for i, f in enumerate(full))[:6]
    assert max(seen) < whole / 3
    pairs = [(rnd.choice(names), rnd.choice(full).lower()) for _ in range(60)] + [("", "a"), ("", ""), ("ab", "ba")]
    assert all(abs(x - S.partial_ratio(a, b)) < 1e-9 for x, (a, b) in zip(S.partial_ratios(*zip(*pairs)), pairs))


def test_tries_find_the_best_few_and_leave_off(monkeypatch):
    """In a block of many rows names are sought along tries: the best six stay exact, few rows are reached."""
    rnd = random.Random(9)
    full = [f"{rnd.choice(['Ana', 'Boris', 'Chloe', 'Dmitri'])} {rnd.choice(['Lopez', 'Smith', 'Okafor'])} {rnd.randint(100, 999)}" for _ in range(690)]
    full += [full[3], full[3].upper(), "y" * 70 + " ana", "Ana", "", "  ", "Zoé \U0001f600 Ito", "77 31"]
    clean = [" ".join(w for w in f.split() if not w.isdigit()) for f in full]
    ids = rnd.sample(range(5000), len(full))
    names = [f[:2].lower() + f[3:].lower() for f in full[:600:50]] + ["ana lopez", "p123@mail.test", "zoé ito", "ana", "x" * 65 + " ana", "q", "31 77", "lopez ana 5"]
    block = S.Roster(ids, full, clean, 0.9)

    def one(name, f, c):
        key, low = S.token_sorted(name), f.lower()
        whole = lambda other: 2 * S.lcs_long(key, other) / (len(key) + len(other))
        return round(max(whole(S.token_sorted(low)), whole(S.token_sorted(c.lower())) if c else 0.0, 0.9 * S.partial_ratio(name, low)), 9)

    want = {n: sorted((-one(n, f, c), i) for i, f, c in zip(ids, full, clean))[:6] for n in names}
    reached = []
    monkeypatch.setattr(S.Tries, "search", lambda self, names, *x, f=S.Tries.search: (lambda out: reached.append(len(out[0])) or out)(f(self, names, *x)))
    at, _, value = block.best(S.Names(names), 6, [-1.0] * len(names), windows=False)
    given = [sorted(v for i, v in zip(at, value) if i == k)[-6] for k in range(len(names))]
    assert all(g <= -want[n][5][0] + 1e-9 for g, n in zip(given, names))
    for floors in ([-1.0] * len(names), given):
        reached.clear()
        got = {}
        for i, who, v in zip(*block.best(S.Names(names), 6, floors)):
            got.setdefault(names[i], []).append((-round(float(v), 9), int(who)))
        assert got == want
    reached.clear()
    block.best(S.Names(names[:12]), 6, given[:12])
    assert 0 < sum(reached) < 12 * len(full) / 10


def test_names_unlike_all_others_share_the_beginnings_of_rows(monkeypatch):
    """Addresses ask every row; beginnings that rows share are compared once, few windows are, and the best six stay exact."""
    rnd = random.Random(10)
    full = [f"{rnd.choice(['Ana', 'Boris', 'Chloe', 'Dmitri'])} {rnd.choice(['Lopez', 'Smith', 'Okafor'])} {rnd.randint(1000, 9999)}" for _ in range(1500)]
    clean = [" ".join(f.split()[:2]) for f in full]
    names = [f"p{rnd.randint(1000, 9999)}@mail.test" for _ in range(4)]
    block = S.Roster(range(len(full)), full, clean, 0.9)
    compared = []
    monkeypatch.setattr(S, "partial_ratios", lambda a, b, f=S.partial_ratios: compared.append(len(a)) or f(a, b))
    at, _, value = block.best(S.Names(names), 6, [-1.0] * len(names), windows=False)
    got = {}
    for i, who, v in zip(*block.best(S.Names(names), 6, [sorted(v for i, v in zip(at, value) if i == k)[-6] for k in range(len(names))])):
        got.setdefault(names[i], []).append((-round(float(v), 9), int(who)))
    for name in names:
        key = S.token_sorted(name)
        whole = lambda other, key=key: 2 * S.lcs_long(key, other) / (len(key) + len(other))
        want = sorted((-round(max(whole(S.token_sorted(f.lower())), whole(S.token_sorted(c.lower())), 0.9 * S.partial_ratio(name, f.lower())), 9), i)
                      for i, (f, c) in enumerate(zip(full, clean)))[:6]
        assert got[name] == want
    assert sum(compared) < len(names) * len(full) / 2
    nodes = sum(len(x) for t in block.tries[0].tries.values() for x in t.chars)
    assert nodes < sum(len(f) for f in full) / 3 and sum(len(x) for t in block.tries[1].tries.values() for x in t.chars) < 150
