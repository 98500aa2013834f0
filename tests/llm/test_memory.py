"""What workers keep between tasks."""

import os

import public_tokenizers

from gleaner.llm import held, piece_codec, suffixes


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_free_memory_goes_back_after_a_group():
    def run(n):
        parts = [bytes([1]) * 50_000 for _ in range(n)]
        return [len(parts), bytes([2]) * 50_000]  # made last, so that what is free lies below it

    before = resident()
    out = held.then_trim(run, 4000)
    assert out[0] == 4000 and resident() - before < 50 << 20


def test_groups_of_substring_dedup_give_memory_back(spark, tmp_path, monkeypatch):
    """Each function of a group of chunks or suffixes ends with a trim in its worker."""
    trimmed = str(tmp_path)

    def told(run, *args):
        out = run(*args)
        open(os.path.join(trimmed, run.__name__), "a").close()
        return out

    monkeypatch.setattr(suffixes, "then_trim", told)
    text = " ".join(f"w{i}" for i in range(40))
    suffixes.remove_repeats(spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string")).collect()
    assert {"send_suffixes", "cut", "answer"} == set(os.listdir(trimmed))


def test_pieces_are_encoded_on_the_tasks_own_thread():
    codec = piece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    before = len(os.listdir("/proc/self/task"))
    codec.decode(*codec.encode([f"word{i} and{i * 7}".encode() for i in range(3000)])[:2])
    assert len(os.listdir("/proc/self/task")) <= before
