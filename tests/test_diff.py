import random
import shutil
import subprocess

import pytest

from diffloom import api
from diffloom.operators import acquire, diff, renames
from diffloom.operators.patch import Patch

FILE = "path string, mode string, content string"


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(row[j + 1], now[-1]))
        row = now
    return row[-1]


def changed(r, lines, n, alphabet):
    out = list(lines)
    for _ in range(n):
        k = r.randint(0, len(out))
        if out and r.random() < 0.5:
            out.pop(min(k, len(out) - 1))
        else:
            out.insert(k, r.choice(alphabet))
    return out


@pytest.mark.parametrize("seed", range(200))
def test_edits_are_fewest_and_rebuild(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(diff, "GREEDY", r.choice([0, 1, 3, 24]))
    alphabet = [str(k) for k in range(r.choice([2, 3, 8, 40]))]
    a = [r.choice(alphabet) for _ in range(r.randint(0, 50))]
    b = changed(r, a, r.randint(0, 9), alphabet) if seed % 2 else [r.choice(alphabet) for _ in range(r.randint(0, 50))]
    before, after = "\n".join(a) + r.choice(["", "\n"]), "\n".join(b) + r.choice(["", "\n"])
    script = list(diff.edits(before, after))
    assert "".join(x for kind, x in script if kind != "after") == before and "".join(x for kind, x in script if kind != "before") == after
    assert sum(kind == "keep" for kind, _ in script) == common(diff.lines_of(before), diff.lines_of(after))


def test_long_texts():
    r = random.Random(1)
    a = [str(r.randint(0, 10_000)) for _ in range(100_000)]
    b = changed(r, a, 200, a)
    kept = diff.matches(a, b)
    assert len(a) + len(b) - 2 * len(kept) <= 200 and all(a[i] == b[j] for i, j in kept)
    assert diff.matches([str(k) for k in range(50_000)], [str(-k - 1) for k in range(50_000)]) == []


def snapshots(seed):
    r = random.Random(seed)
    text = lambda n, end="\n": "\n".join(f"line {r.randint(0, 60)}" for _ in range(n)) + end
    before = {f"dir/f{k}.txt": ("100644", text(r.randint(1, 60), r.choice(["", "\n"]))) for k in range(12)}
    before |= {"moved.txt": ("100644", text(40)), "gone.txt": ("100644", text(5)), "mode.sh": ("100644", text(3)), "é \"x\".txt": ("100644", text(9)), "empty": ("100644", ""), "stays.txt": ("100644", text(30))}
    after = dict(before)
    for k in range(0, 12, 2):
        path = f"dir/f{k}.txt"
        lines = before[path][1].split("\n")
        after[path] = ("100644", "\n".join(changed(r, lines, r.randint(1, 6), [f"line {n}" for n in range(60)])))
    del after["moved.txt"], after["gone.txt"]
    after["new/moved.txt"] = ("100644", before["moved.txt"][1] + "one more line\n")
    after["copy.txt"] = ("100644", before["stays.txt"][1] + "and one\n")
    after |= {"mode.sh": ("100755", before["mode.sh"][1]), "é \"x\".txt": ("100644", text(9)), "made.txt": ("100644", text(7, "")), "empty2": ("100644", "")}
    return before, after


@pytest.mark.parametrize("context", [0, 3, 10])
def test_patches_apply(spark, tmp_path, context):
    before, after = snapshots(context)
    rows = lambda files: spark.createDataFrame([(p, m, c) for p, (m, c) in files.items()], FILE)
    patches = acquire.acquired(rows(before), rows(after), context)
    found = {r.path: r.patch for r in patches.collect()}
    assert "rename from moved.txt\nrename to new/moved.txt" in found["new/moved.txt"] and "copy from stays.txt" in found["copy.txt"] and "deleted file mode" in found["gone.txt"]
    assert Patch(patches, "path", "patch").errors.count() == 0
    if shutil.which("git") is None:
        pytest.skip("no git")
    for p, (m, c) in before.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(c)
    git = lambda *a, **k: subprocess.run(["git", "-c", "core.fileMode=true", *a], cwd=tmp_path, check=True, **k)
    git("init", "-q")
    git("apply", "--unidiff-zero", "-", input=acquire.one_patch(patches).first().patch.encode())
    there = {str(p.relative_to(tmp_path)): ("100755" if p.stat().st_mode & 0o100 else "100644", p.read_text()) for p in tmp_path.rglob("*") if p.is_file() and ".git" not in p.parts}
    assert there == after


def test_compare(spark):
    before, after = snapshots(7)
    before["bin"], after["bin"] = ("100644", "a\0b"), ("100644", "a\0c")
    before["sub"], after["sub"] = ("160000", "a" * 40), ("160000", "b" * 40)
    rows = lambda files: spark.createDataFrame([(p, m, c) for p, (m, c) in files.items()], FILE)
    found = api.compare(rows(before), rows(after))
    status = {r.path: (r.status, r.similarity) for r in found.files.collect()}
    assert status["new/moved.txt"][0] == "renamed" and status["copy.txt"][0] == "copied" and status["gone.txt"][0] == "deleted" and status["made.txt"][0] == "added"
    assert {r.kind for r in found.units.collect()} == {"text", "binary", "mode", "rename", "copy", "submodule"}
    assert set(status) == {p for p in {**before, **after} if before.get(p) != after.get(p)} - {"moved.txt"}
    same = rows(before)
    assert api.compare(same, same).files.count() == 0
    with pytest.raises(ValueError, match="context"):
        api.compare(same, same, context_lines=-1)


@pytest.mark.parametrize("seed", range(3))
def test_similarity(spark, seed):
    r = random.Random(seed)
    bases = [[f"{k} {r.randint(0, 9)}" for k in range(r.randint(1, 30))] for _ in range(6)] + [["same"] * 20]
    texts = lambda n: ["\n".join(changed(r, r.choice(bases), r.randint(0, 12), ["same", "x", "yy"])) + r.choice(["", "\n"]) for _ in range(n)]
    old, new = {f"o{k}": (t, k % 2 == 0) for k, t in enumerate(texts(25))}, {f"n{k}": t for k, t in enumerate([*texts(25), ""])}
    new["exact"] = old["o1"][0]

    def score(a, b):
        a, b = diff.lines_of(a), diff.lines_of(b)
        size = lambda x: sum(len(y.encode()) for y in x)
        return size(k for k in set(a) for _ in range(min(a.count(k), b.count(k)))) * 100 // max(size(a), size(b), 1)

    best = {}
    for p, t in new.items():
        found = min(((-s, not gone, o) for o, (u, gone) in old.items() if (s := score(u, t)) >= 50), default=None)
        if found:
            best[p] = found
    taken = {}
    for p, (s, stays, o) in best.items():
        if not stays:
            taken[o] = min(taken.get(o, (s, p)), (s, p))
    want = sorted((p, o, -s, "renamed" if not stays and taken[o][1] == p else "copied") for p, (s, stays, o) in best.items())
    got = renames.similar(spark.createDataFrame([(p, t, g) for p, (t, g) in old.items()], "path string, text string, removed boolean"), spark.createDataFrame(list(new.items()), "path string, text string"))
    assert sorted(tuple(x) for x in got.collect()) == want and want
