import random
from collections import Counter

from revtables.operators.cochange import co_changes, top_companions, top_companions_of_all
from revtables.schema import SYMBOL

OTHER = [f"other_{c}" for c in SYMBOL]


def table(spark, commits):
    rows = [
        (commit, commit * 10, kind, name, "f", 1, 1, 1)
        for commit, symbols in commits.items()
        for kind, name in sorted(symbols)
    ]
    schema = (
        "commit_id long, seconds_since_epoch long, kind string, qualifiers string, file_path string,"
        "novel_lhs long, novel_rhs long, size_after long"
    )
    return spark.createDataFrame(rows, schema)


def brute_force(commits, limit):
    together, own = Counter(), Counter()
    for symbols in commits.values():
        for a in symbols:
            own[a] += 1
            for b in symbols:
                if a != b and b[0] != "file":
                    together[a, b] += 1
    out = set()
    for a in own:
        ranked = sorted((-n, b) for (x, b), n in together.items() if x == a)[:limit]
        out |= {(a, b, -n, -n / own[a], rank + 1) for rank, (n, b) in enumerate(ranked)}
    return out


def result(df):
    return {
        ((r.kind, r.qualifiers), (r.other_kind, r.other_qualifiers), r.together, r.ratio, r["rank"])
        for r in df.collect()
    }


def random_commits(seed, symbols=25, commits=30, giants=4):
    rng = random.Random(seed)
    names = [("fn", f"s{n:02}") for n in range(symbols)] + [("file", ""), ("file", "x")]
    out = {c: set(rng.sample(names, rng.randrange(1, 5))) for c in range(commits)}
    for g in range(giants):
        out[1000 + g] = set(rng.sample(names, symbols - 3))
    return out


def test_wide_commits_give_the_same_as_pairing_everything(spark):
    for seed in range(3):
        commits = random_commits(seed)
        want = brute_force(commits, 4)
        changes = table(spark, commits).cache()
        assert result(top_companions_of_all(changes, limit=4, wide=4)) == want
        assert result(top_companions_of_all(changes, limit=4, wide=1)) == want
        assert result(top_companions_of_all(changes, limit=4)) == want


def test_a_commit_with_most_of_the_rows(spark):
    commits = {1: {("fn", f"s{n:04}") for n in range(3000)}, 2: {("fn", "s0001"), ("fn", "s2999")}}
    top = top_companions_of_all(table(spark, commits), limit=3, wide=200)
    got = [r for r in result(top) if r[0] == ("fn", "s2999")]
    assert sorted(got, key=lambda r: r[4]) == [
        (("fn", "s2999"), ("fn", "s0001"), 2, 1.0, 1),
        (("fn", "s2999"), ("fn", "s0000"), 1, 0.5, 2),
        (("fn", "s2999"), ("fn", "s0002"), 1, 0.5, 3),
    ]
    assert top.count() == 9000


def test_one_symbol_and_all_symbols_agree(spark):
    commits = random_commits(9)
    changes = table(spark, commits).cache()
    asked = changes.select(*SYMBOL).distinct()
    assert result(top_companions(co_changes(changes, asked))) == result(top_companions_of_all(changes, wide=5))
