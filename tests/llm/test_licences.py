"""Tags and expressions of the licence scan against a plain reading of the text."""

import re
import time

import pytest

from idlattice.llm import licenses

CASES = [
    ("SPDX-License-Identifier: MIT", {"mit"}, 0.95),
    ("x\n# spdx_license.identifier : (MIT OR Apache-2.0) AND BSD-3-Clause\nx", {"mit", "apache-2.0", "bsd-3-clause"}, 1 - 0.05**3),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only"}, 0.95),
    ("SPDX-License-Identifier: foobar-thing", {"unknown:foobar-thing"}, 0.5),
    ("Licensed under GPLv2. License: MIT.", {"mit"}, 0.95),
    ("licence = ISC or later", {"isc"}, 0.95),
    ("License: see the file", set(), 0.0),
    ("SPDX-License-Identifier", set(), 0.5),
    ("SPDX-License-Identifier: (MIT", set(), 0.5),
    ("The MIT License. cc by", {"mit", "cc-by"}, 0.98),
    ("", set(), 0.0),
]


@pytest.mark.parametrize(("text", "labels", "score"), CASES)
def test_labels(text, labels, score):
    found = licenses.scan_text(text.encode())
    assert set(found["labels"]) == labels and found["score"] == pytest.approx(score)


def test_expressions_longer_than_the_window():
    names = [f"MIT OR\n * Apache-2.0{' ' * k} AND" for k in range(200)]
    found = licenses.scan_text(("SPDX-License-Identifier: " + " ".join(names) + " ISC é SPDX-License-Identifier:" + " " * 5000 + "Zlib").encode())
    first, second = found["expressions"]
    assert first[0] == re.sub(r"[\s*]+", " ", " ".join(names)) + " ISC" and second[0] == "Zlib"


def test_time_follows_the_text():
    def seconds(n):
        began = time.perf_counter()
        found = licenses.scan_text(b"// SPDX-License-Identifier: MIT OR Apache-2.0\nLicense: ISC\n" * n)
        assert len(found["expressions"]) == 2 * n
        return time.perf_counter() - began

    seconds(10)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.05)  # a megabyte; quadratic work would take 16 times as long


def test_table_of_identifiers():
    assert len(licenses.GRADES) > 80 and set(licenses.GRADES.values()) == {0, 1, 2}
    assert licenses.grade_of("gpl-3.0-or-later") == 1 and licenses.grade_of("busl-1.1") == 0 == licenses.grade_of("nobody-knows")
