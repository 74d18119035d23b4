"""Licences as people write them: later versions, names inside sentences, SPDX expressions, denials, longer names."""

import pytest

from talkspan.llm import licences

BSD = {i: s for i, s in licences.SENTENCES if i.startswith("bsd")}
BSD2 = " ".join(BSD[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
NOR = " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

CASES = [
    ("Licensed under the GNU General Public License version 2 or (at your option) any later version.", ["GPL-2.0-or-later"]),
    ("Licensed under the GNU GPL v2 or any later version", ["GPL-2.0-or-later"]),
    ("Licensed under the GNU GPL v2, or\n# any later version", ["GPL-2.0-or-later"]),
    ("Released under the GNU Lesser General Public License, version 3 or (at your option) any later version.", ["LGPL-3.0-or-later"]),
    ("under the terms of the GNU General Public License, version 2.", ["GPL-2.0-only"]),
    ("Licensed under the GNU GPL v2. Later versions of this file, or any later version, differ.", ["GPL-2.0-only"]),
    ("distributed under the terms of version 3 of the GNU Affero General Public License", ["AGPL-3.0-only"]),
    (BSD2, ["BSD-2-Clause"]),
    (BSD2 + " Neither the name of the copyright holder" + NOR, ["BSD-3-Clause"]),
    (BSD2 + " Neither the name of Google Inc." + NOR, ["BSD-3-Clause"]),
    (BSD2 + " * Neither the name of the University of Somewhere, Department of\n * Things" + NOR, ["BSD-3-Clause"]),
    ("Neither the name of the rose nor the rose", []),
    ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
    ("// SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) AND MIT", ["GPL-2.0-only", "BSD-3-Clause", "MIT"]),
    ("SPDX-License-Identifier: GPL-2.0+", ["GPL-2.0-or-later"]),
    ("SPDX-License-Identifier: GPL-2.0", ["GPL-2.0-only"]),
    ("SPDX-License-Identifier: MIT\nApache-2.0 or MIT, you say?", ["MIT"]),
    ("Take it or MIT.", []),
    ("Licensed under GPL-2.0+", ["GPL-2.0-or-later"]),
    ("License: GPLv3", ["GPL-3.0-only"]),
    ("Licensed under the GPLv3+.", ["GPL-3.0-or-later"]),
    ("Apache License\n                        Version 2.0, January 2004\n     http://www.apache.org/licenses/", ["Apache-2.0"]),
    ("License: MIT", ["MIT"]),
    ("License: MIT\nCopyright somebody", ["MIT"]),
    ("This is not licensed under the MIT License.", []),
    ("It isn't licensed under the MIT License", []),
    ("No longer released under the MIT License", []),
    ("never distributed under the terms of the MIT License", []),
    ("You may not. Licensed under the MIT License.", ["MIT"]),
    ("available under the MIT OpenCourseWare terms", []),
    ("available under the mit opencourseware terms", []),
    ("available under the MIT licence", ["MIT"]),
    ("Licensed under MIT or Apache-2.0", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
    ("Licensed under the Mozilla Public License, v. 2.0. And more.", ["MPL-2.0"]),
]


@pytest.mark.parametrize("text, want", CASES)
def test_written_notices(text, want):
    for wrapped in (text, "Some prose. " + text, text.replace(" the ", "\n# the ")):
        assert licences.scan(wrapped)[1] == want


def test_query_gives_what_scan_gives(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    for k, (text, want) in enumerate(CASES):
        assert (got[k].sentence_ids, got[k].licences) == (licences.scan(text)[0], want)
        assert got[k].reuse_allowed == (all(licences.PERMISSIVE[x] for x in want) if want else None)
