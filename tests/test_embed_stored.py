"""Embedding requests whose replies are kept: reruns ask only for what is missing."""

import pandas as pd
import pytest

from pagewright.operators import embed as E


def embedder_that_notes(folder, bad=()):
    def embed(texts):
        import uuid
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("|".join(texts))
        if any(t in bad for t in texts):
            raise ConnectionError("no reply")
        return [[float(len(t)), 1.0] for t in texts]
    return embed


def calls(folder):
    return sorted(f.read_text() for f in folder.iterdir())


def table(spark, texts):
    return spark.createDataFrame([(10 * i + j, i, j, t) for i, ts in enumerate(texts) for j, t in enumerate(ts)],
                                 "id long, inode_id long, index int, text string")


@pytest.mark.parametrize("per_commit", [1, 2, 100])
def test_rerun_sends_only_failed_requests(spark, tmp_path, per_commit):
    pages, store = table(spark, [["a", "bb", "ccc"], ["d"], ["ee", "f"]]), str(tmp_path / "store")
    folders = [tmp_path / n for n in ("one", "two", "three")]
    for f in folders:
        f.mkdir()
    first = E.embed_stored(pages, embedder_that_notes(folders[0], bad=["ccc", "d"]), store, 2, per_commit)
    assert {r["id"]: (r["status"], r["run"]) for r in first.collect()} == {
        0: ("ok", 0), 1: ("ok", 0), 2: ("failed", 0), 10: ("failed", 0), 20: ("ok", 0), 21: ("ok", 0)}
    assert calls(folders[0]) == ["a|bb", "ccc", "d", "ee|f"]
    second = E.embed_stored(pages, embedder_that_notes(folders[1]), store, 2, per_commit)
    assert {r["id"]: (r["embedding"], r["run"]) for r in second.collect()} == {
        0: ([1, 1], 0), 1: ([2, 1], 0), 2: ([3, 1], 1), 10: ([1, 1], 1), 20: ([2, 1], 0), 21: ([1, 1], 0)}
    assert calls(folders[1]) == ["ccc", "d"]
    # A page with another text is asked for again, the others are not.
    changed = E.embed_stored(table(spark, [["a", "bbbb", "ccc"], ["d"]]), embedder_that_notes(folders[2]), store, 2, per_commit)
    assert {r["id"]: r["embedding"] for r in changed.collect()} == {0: [1, 1], 1: [4, 1], 2: [3, 1], 10: [1, 1]}
    assert calls(folders[2]) == ["bbbb"]


def test_a_run_that_breaks_off_keeps_its_commits(spark, tmp_path, monkeypatch):
    pages, store, notes = table(spark, [["a"], ["b"], ["c"], ["d"]]), str(tmp_path / "store"), tmp_path / "calls"
    notes.mkdir()
    whole, asked = E.embed_pages, []

    def breaks(part, *args):
        asked.append(1)
        if len(asked) == 3:
            raise KeyboardInterrupt
        return whole(part, *args)

    monkeypatch.setattr(E, "embed_pages", breaks)
    with pytest.raises(KeyboardInterrupt):
        E.embed_stored(pages, embedder_that_notes(notes), store, 64, 1)
    done = E.stored_vectors(spark, store).count()
    assert done == len(calls(notes))
    out = E.embed_stored(pages, embedder_that_notes(notes), store, 64, 1)
    assert sorted(r["embedding"] for r in out.collect()) == [[1, 1]] * 4
    assert calls(notes) == ["a", "b", "c", "d"]


def test_no_pages_no_calls(spark, tmp_path):
    assert E.embed_stored(table(spark, []), None, str(tmp_path / "none")).count() == 0


def test_requests_are_not_split_between_frames():
    f = pd.DataFrame({"inode_id": [1, 1, 1, 2, 2, 3], "batch": [0, 0, 1, 0, 0, 0], "n": range(6)})
    for cut in range(7):
        out = list(E.whole_requests([f[:cut], f[cut:]]))
        assert pd.concat(out)["n"].tolist() == list(range(6))
        assert sum(len(g.drop_duplicates(["inode_id", "batch"])) for g in out) == 4
