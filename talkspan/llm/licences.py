"""Licence scans by sentence rules: normalised sentences map to identifiers, identifier sequences to licences.

A text is read as its words in lower case; marks, line breaks and comment signs between them do not matter, so wrapped
and commented notices are found. Known sentences are runs of words in one trie; at each place the longest known
sentence is taken. A rule holds where its identifiers follow each other directly in the document's sequence of known
sentences (unknown words between are ignored, so a sentence with a name inside is two); rules are tried by precedence and
a sentence serves one rule only. A notice that names a licence counts unless it is denied ("not licensed under") or its
name may go on ("MIT OpenCourseWare"), and "or any later version" behind a name makes another sentence. Further
identifiers of an SPDX expression count behind its first.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Licences by SPDX identifier (names in notices, reuse in training data allowed).
NAMES = {
    "MIT": (["MIT License", "MIT"], True),
    "MIT-0": (["MIT No Attribution License", "MIT-0"], True),
    "ISC": (["ISC License"], True),
    "0BSD": (["Zero-Clause BSD License", "0BSD"], True),
    "BSD-2-Clause": (["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"], True),
    "BSD-3-Clause": (["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"], True),
    "Apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"], True),
    "Zlib": (["zlib License"], True),
    "BSL-1.0": (["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"], True),
    "Unlicense": (["Unlicense"], True),
    "WTFPL": (["Do What The Fuck You Want To Public License", "WTFPL"], True),
    "PSF-2.0": (["Python Software Foundation License Version 2", "PSF-2.0"], True),
    "OFL-1.1": (["SIL Open Font License, Version 1.1", "OFL-1.1"], True),
    "Artistic-2.0": (["Artistic License 2.0", "Artistic-2.0"], True),
    "MPL-2.0": (["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL-2.0"], False),
    "EPL-1.0": (["Eclipse Public License, Version 1.0", "Eclipse Public License v1.0", "EPL-1.0"], False),
    "EPL-2.0": (["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0", "EPL-2.0"], False),
    "EUPL-1.2": (["European Union Public Licence, Version 1.2", "EUPL-1.2"], False),
    "CC0-1.0": (["Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal", "CC0 1.0"], True),
}
# The Creative Commons licences (parts of the code, part of the name, reuse allowed) and their versions.
COMMONS = [("BY", "Attribution", True), ("BY-SA", "Attribution-ShareAlike", False), ("BY-ND", "Attribution-NoDerivatives", False), ("BY-NC", "Attribution-NonCommercial", False), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", False), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", False)]
VERSIONS = ["2.0", "2.5", "3.0", "4.0"]
for _code, _name, _ok in COMMONS:
    for _v in VERSIONS:
        NAMES[f"CC-{_code}-{_v}"] = ([f"CC {_code} {_v}", f"Creative Commons {_name} {_v}", f"Creative Commons {_name} {_v} {'International' if _v == '4.0' else 'Unported'}"], _ok)
# The GNU licences (name, short name, versions), and what says that later versions will do.
FAMILIES = [("GNU General Public License", "GPL", ["2", "3"]), ("GNU Lesser General Public License", "LGPL", ["2.1", "3"]), ("GNU Affero General Public License", "AGPL", ["3"])]
LATER = ["or later", "or any later version", "or (at your option) any later version", "or at your option any later version", "or later version", "or later versions", "or newer", "and later"]
#: Identifiers that stand in SPDX expressions, also those out of use.
SPDX = {name: name for name in NAMES}
for _name, _short, _all in FAMILIES:
    for _v in _all:
        _full = _v if "." in _v else f"{_v}.0"
        _exact, _later = f"{_short}-{_full}-only", f"{_short}-{_full}-or-later"
        _said = [x for v in dict.fromkeys((_v, _full)) for x in (f"{_name}, version {v}", f"{_name} v{v}", f"{_name} {v}", f"version {v} of the {_name}", f"{_short}v{v}", f"{_short} v{v}", f"{_short} version {v}", f"{_short}-{v}", f"GNU {_short}v{v}", f"GNU {_short} v{v}", f"GNU {_short} version {v}", f"GNU {_short} {v}")]
        NAMES[_exact] = ([*_said, _exact], False)
        NAMES[_later] = ([f"{x} {t}" for x in _said for t in LATER] + [x + "+" for x in _said if x.endswith((_v, _full))] + [_later], False)
        SPDX |= {_exact: _exact, _later: _later, f"{_short}-{_full}": _exact, f"{_short}-{_full}+": _later}
#: Notices that name a licence; each is a sentence for every name.
NOTICES = ["Released under the {}", "Licensed under the {}", "Licensed under {}", "Released under {}", "is licensed under the {}", "is licensed under a {}", "is licensed under {}", "are licensed under the {}", "distributed under the {}", "available under the {}", "under the terms of the {}", "under the terms of {}", "subject to the terms of the {}", "License: {}"]
#: Words that deny the notice behind them, and words that may follow a name that does not end in "License" or a version.
DENIALS = {"not", "never", "cannot", "isn", "aren", "wasn", "nor", "neither"}
FOLLOWING = {"license", "or", "and", "by", "see", "for", "with", "in", "as", "which", "this", "that", "unless", "but"}

# Sentences of licence texts (identifier, wording).
SENTENCES = [
    ("mit-title", "The MIT License (MIT)"),
    ("mit-title", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("mit-subject", "subject to the following conditions"),
    ("mit-condition", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("as-is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mit-liable", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-title", "ISC License"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("apache2-title", "Apache License Version 2.0, January 2004"),
    ("apache2-head", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache2-compliance", "you may not use this file except in compliance with the License."),
    ("apache2-obtain", "You may obtain a copy of the License at"),
    ("apache2-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache2-see", "See the License for the specific language governing permissions and limitations under the License."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-neither", "Neither the name of"),
    ("bsd-nor", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-nor", "nor the names of the contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl3-free", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2-free", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl3-exact", "it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("gpl2-exact", "it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2."),
    ("lgpl3-free", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl21-free", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl3-free", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-hope", "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mpl2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("epl2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("zlib-as-is", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("boost-grant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("reserved", "All rights reserved."),
]

# Rules in order of precedence (licence, identifiers that follow each other); notices and tags come after them.
RULES = [
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-neither", "bsd-nor"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-title", "mit-grant", "mit-subject", "mit-condition", "as-is", "mit-liable"]),
    ("MIT", ["mit-grant", "mit-subject", "mit-condition", "as-is", "mit-liable"]),
    ("MIT", ["mit-title", "mit-grant", "mit-subject", "mit-condition", "as-is"]),
    ("MIT", ["mit-grant", "mit-subject", "mit-condition", "as-is"]),
    ("MIT", ["mit-grant", "mit-subject", "mit-condition"]),
    ("MIT-0", ["mit-grant", "as-is"]),
    ("MIT", ["mit-title", "mit-grant"]),
    ("ISC", ["isc-title", "isc-grant"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Apache-2.0", ["apache2-head", "apache2-compliance", "apache2-obtain", "apache2-as-is", "apache2-see"]),
    ("Apache-2.0", ["apache2-head", "apache2-compliance", "apache2-obtain", "apache2-as-is"]),
    ("Apache-2.0", ["apache2-head", "apache2-compliance", "apache2-obtain"]),
    ("Apache-2.0", ["apache2-head", "apache2-compliance"]),
    ("Apache-2.0", ["apache2-head"]),
    ("Apache-2.0", ["apache2-title"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl3-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-3.0-only", ["gpl3-exact"]),
    ("GPL-2.0-only", ["gpl2-exact"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("MPL-2.0", ["mpl2"]),
    ("EPL-2.0", ["epl2"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
]
for _id, (_names, _) in NAMES.items():
    SENTENCES += [(f"notice:{_id}", n.format(x)) for x in _names for n in NOTICES]
    RULES += [(_id, [f"{kind}:{_id}"]) for kind in ("notice", "spdx", "more")]
for _x, _id in SPDX.items():
    SENTENCES += [(f"spdx:{_id}", f"SPDX-License-Identifier: {_x}"), (f"more:{_id}", f"OR {_x}"), (f"more:{_id}", f"AND {_x}")]
RULES.append(("Proprietary", ["reserved"]))
PERMISSIVE = {n: ok for n, (_, ok) in NAMES.items()} | {"Proprietary": False}

#: Every known sentence holds one of these stems inside a word, however it is wrapped, so texts without them need no walk.
STEMS = r"(?i)licen[sc]|permi|copyright|redistribut|warrant|reserved|mozilla|unencumbered|subject|released|distributed|available|terms|neither"
WORD = re.compile(r"\w+\+?")


def _word(w: str) -> str:
    w = w.lower()
    return "license" if w == "licence" else w


def normal(text: str) -> list[str]:
    return [_word(w) for w in WORD.findall(text)]


TRIE: dict = {}
for _i, _s in SENTENCES:
    _node = TRIE
    for _w in normal(_s):
        _node = _node.setdefault(_w, {})
    if _node.setdefault("", _i) != _i and not _i.startswith("notice:"):
        raise ValueError(f"one sentence with two identifiers: {_s}")
    if not any(re.search(STEMS, w) for w in normal(_s)) and not _i.startswith("more:"):  # those count behind others only
        raise ValueError(f"a sentence without a stem: {_s}")


def identifiers(words: list[str], fits=None) -> list[str]:
    """Identifiers of the known sentences in order; at each place the longest, and none overlaps another.

    fits(identifier, first, end, before): whether a sentence counts; before: identifier and end of the one before it.
    """
    out, at, n, before = [], 0, len(words), ("", -1)
    while at < n:
        node, k, found, end = TRIE.get(words[at]), at + 1, None, at
        while node is not None:
            if "" in node:
                found, end = node[""], k
            if k == n:
                break
            node, k = node.get(words[k]), k + 1
        if found is None or (fits and not fits(found, at, end, before)):
            at += 1
        else:
            out.append(found)
            at, before = end, (found, end)
    return out


def _read(text: str) -> list[str]:
    """identifiers() of a text, but of notices that are denied or name something longer, and of loose SPDX parts."""
    spans = [m.span() for m in WORD.finditer(text)]
    words = [_word(text[a:b]) for a, b in spans]

    def denied(at: int) -> bool:
        for k in range(max(0, at - 2), at):
            no = words[k] in DENIALS or (words[k] == "longer" and k and words[k - 1] == "no")
            if no and not re.search(r"[.;!?]", text[spans[k][1] : spans[at][0]]):
                return True
        return False

    def goes_on(end: int) -> bool:
        if end == len(words):
            return False
        last, gap = words[end - 1], text[spans[end - 1][1] : spans[end][0]]
        if last[-1].isdigit():
            return gap == "." and words[end].isdigit() and words[end] != "0"
        return last != "license" and not gap.strip(" \t") and words[end] not in FOLLOWING

    def fits(found: str, at: int, end: int, before: tuple[str, int]) -> bool:
        if found.startswith("more:"):
            return before[1] == at and before[0].startswith(("spdx:", "more:"))
        return not found.startswith("notice:") or not (denied(at) or goes_on(end))

    return identifiers(words, fits)


def scan(text: str | None) -> tuple[list[str], list[str]]:
    """(sentence identifiers in order, licences in order of their first sentence); null and empty texts have none."""
    ids = _read(text or "")
    free, found, held = [True] * len(ids), [], set(ids)
    for name, need in RULES:
        if not held.issuperset(need):
            continue
        n, k = len(need), 0
        while k + n <= len(ids):
            if ids[k : k + n] == need and all(free[k : k + n]):
                found.append((k, name))
                free[k : k + n] = [False] * n
                k += n
            else:
                k += 1
    return ids, list(dict.fromkeys(name for _, name in sorted(found)))


def scan_licences(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, sentence_ids, licences (both arrays, in order), licence (the first or null),
    reuse_allowed (all licences that are named permit it, also where one may choose; null where none was found).

    Null and empty texts hold none. A sentence serves one rule only, rules by precedence; two rules cannot start at one
    sentence, so there are no ties. Null doc_ids and repeated rows pass through. Empty table: empty result. Extra
    columns are not read.
    """

    def run(batches):
        for b in batches:
            hit = pc.match_substring_regex(b.column(1), STEMS).fill_null(False).to_pylist()
            texts = b.column(1)
            got = [scan(texts[k].as_py()) if h else ([], []) for k, h in enumerate(hit)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g[0] for g in got], pa.list_(pa.string())),
                    pa.array([g[1] for g in got], pa.list_(pa.string())),
                    pa.array([g[1][0] if g[1] else None for g in got], pa.string()),
                    pa.array([all(PERMISSIVE[x] for x in g[1]) if g[1] else None for g in got], pa.bool_()),
                ],
                ["doc_id", "sentence_ids", "licences", "licence", "reuse_allowed"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, sentence_ids array<string>, licences array<string>, licence string, reuse_allowed boolean")
