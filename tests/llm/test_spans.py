"""Spans of notices that stand next to each other."""

from logloom.llm import op1_license_scan

EXACT, DAMAGED = "released under the mit license", "released undr the mit license"


def test_damaged_notices_beside_exact_ones_keep_their_spans():
    scanner = op1_license_scan.Scanner({"mit": [EXACT]})
    for parts in ([DAMAGED, EXACT], [DAMAGED, DAMAGED, EXACT], [EXACT, DAMAGED, EXACT, DAMAGED], [DAMAGED] * 3 + [EXACT] * 2 + [DAMAGED] * 2):
        got = scanner.fuzzy(" ".join(parts))
        assert [e for *_, e, _ in got] == [int(p == DAMAGED) for p in parts]
        assert all(b <= c for (_, _, b, *_), (_, c, *_) in zip(got, got[1:]))
