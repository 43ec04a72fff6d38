"""Operator 6, license scans by sentence rules, with DataFrame functions only.

A text is split into pieces (at line ends and after . ! ? ; : before white space), each is normalised (A-Z in
lower case, runs of all but letters, digits and dots as one space, no dots or spaces at the ends, so comment marks at
the beginning of a line are gone too). A sentence is a piece or a run of pieces with nothing but single line ends
between them, as sentences are wrapped over lines; those in the table of known license sentences are found. Of
sentences that end or begin at the same piece the longest counts, and no piece counts twice. The identifiers of those found, in the order of
the text, form a sequence; the ordered rules name licenses by runs of identifiers in it. A rule takes the runs that it fits
away from the later rules of its license family, so a text under two licenses of a family has both, and what is part of
a longer run isn't named again. n_sentences counts pieces, as the SQL does, which knows sentences of one piece only.
The table of sentences and the rules can be given by the caller. A license is also known by an SPDX tag, by its name in a project's own
words and by its title; "All rights reserved" is a notice.

Defined cases: null and empty texts have no sentence and no license; repeated sentences repeat their
identifier, repeated rows their result; whole texts are read, however long; an empty table gives an empty result; other columns are ignored,
whatever their names; the key may be null.
"""

from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import ascii_lower

#: Known sentences as they are written, by identifier.
SENTENCES = {
    "ApacheLicensed": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'],
    "ApacheNotUse": ["you may not use this file except in compliance with the License"],
    "ApacheCopy": ["You may obtain a copy of the License at"],
    "AsIsBasis": ['distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "MitReleased": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License"],
    "MitPermission": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
    ],
    "MitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "Gpl3Licensed": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"],
    "GplFree": [
        "This program is free software",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "Gpl3OrLater": ["either version 3 of the License, or (at your option) any later version"],
    "Gpl2OrLater": ["either version 2 of the License, or (at your option) any later version"],
    "Gpl2Licensed": ["This work is licensed under the GNU General Public License, version 2"],
    "Lgpl3Licensed": ["This work is licensed under the GNU Lesser General Public License, version 3"],
    "CcByNc4": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"],
    "CcBy4": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"],
    "CcBySa4": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"],
    "Cc0": ["Released under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0"],
    "BsdRedistribution": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ],
    "BsdNoEndorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ],
    "Mpl2Licensed": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "AllRights": ["All rights reserved"],
}
#: Further sentences as licenses and notices publish them, whole, by the identifiers that each stands
#: for. The SQL doesn't know these.
PUBLISHED = {
    ("AsIsBasis",): [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'
    ],
    ("MitPermission",): [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'
    ],
    ("MitNotice",): [
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"
    ],
    ("GplFree", "Gpl3OrLater"): [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    ("GplFree", "Gpl2OrLater"): [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"
    ],
    ("GplFree", "Gpl3Licensed"): [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    ],
    ("GplFree", "Gpl2Licensed"): [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    ],
    ("Lgpl3Licensed",): [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3"
    ],
    ("CcByNc4",): [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    ("CcBy4",): [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "This work is licensed under the Creative Commons Attribution 4.0 International License",
    ],
    ("CcBySa4",): [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
        "This file is licensed under the Creative Commons Attribution-Share Alike 4.0 International license",
    ],
    ("Cc0",): ["CC0 1.0 Universal"],
    ("Lgpl3OrLater",): [
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    ("Lgpl21OrLater",): [
        "either version 2.1 of the License, or (at your option) any later version",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    ],
    ("Agpl3OrLater",): [
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    ("IscPermission",): [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ],
    ("ZlibPermission",): [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ],
    ("Unencumbered",): ["This is free and unencumbered software released into the public domain"],
    ("Boost1",): ["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    ("Epl2",): [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    ],
    ("BsdNoEndorse",): [
        "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ],
}
#: Rules in order, as (family, license, run of identifiers).
RULES = [
    ("apache", "Apache-2.0", ["ApacheLicensed"]),
    ("apache", "Apache-2.0", ["ApacheNotUse", "ApacheCopy"]),
    ("mit", "MIT", ["MitPermission", "MitNotice"]),
    ("mit", "MIT", ["MitPermission"]),
    ("mit", "MIT", ["MitReleased"]),
    ("gpl", "GPL-3.0-or-later", ["GplFree", "GplFree", "Gpl3OrLater"]),
    ("gpl", "GPL-2.0-or-later", ["GplFree", "GplFree", "Gpl2OrLater"]),
    ("gpl", "GPL-3.0-only", ["Gpl3Licensed"]),
    ("gpl", "GPL-2.0-only", ["Gpl2Licensed"]),
    ("lgpl", "LGPL-3.0-or-later", ["Lgpl3OrLater"]),
    ("lgpl", "LGPL-2.1-or-later", ["Lgpl21OrLater"]),
    ("lgpl", "LGPL-3.0-only", ["Lgpl3Licensed"]),
    ("agpl", "AGPL-3.0-or-later", ["Agpl3OrLater"]),
    ("cc-by-nc", "CC-BY-NC-4.0", ["CcByNc4"]),
    ("cc-by-sa", "CC-BY-SA-4.0", ["CcBySa4"]),
    ("cc-by", "CC-BY-4.0", ["CcBy4"]),
    ("cc0", "CC0-1.0", ["Cc0"]),
    ("bsd", "BSD-3-Clause", ["BsdRedistribution", "BsdNoEndorse"]),
    ("bsd", "BSD-2-Clause", ["BsdRedistribution"]),
    ("mpl", "MPL-2.0", ["Mpl2Licensed"]),
    ("isc", "ISC", ["IscPermission"]),
    ("zlib", "Zlib", ["ZlibPermission"]),
    ("unlicense", "Unlicense", ["Unencumbered"]),
    ("boost", "BSL-1.0", ["Boost1"]),
    ("epl", "EPL-2.0", ["Epl2"]),
    ("reserved", "All-Rights-Reserved", ["AllRights"]),
]
#: The ids that a tag may give (`SPDX-License-Identifier: MIT`), and the names that projects call some licenses by.
TAGS = [
    *"0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0".split(),
    *"CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later".split(),
    *"LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense WTFPL Zlib".split(),
]
NAMES = {
    "MIT": ["MIT License", "MIT license (MIT)"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "GPL-3.0-only": ["GNU General Public License v3.0", "GPL-3.0 License", "GPLv3 License"],
    "GPL-2.0-only": ["GNU General Public License v2.0", "GPL-2.0 License", "GPLv2 License"],
    "LGPL-3.0-only": ["GNU Lesser General Public License v3.0"],
    "AGPL-3.0-only": ["GNU Affero General Public License v3.0", "AGPL-3.0 License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "MPL-2.0 License"],
    "ISC": ["ISC License"],
    "Unlicense": ["Unlicense"],
}
SAYS_WHERE = ["", " see the LICENSE file for details", " see the LICENSE.md file for details", " see the LICENSE LICENSE file for details", " see LICENSE for details"]
#: Headings of the licenses' own texts.
TITLES = {
    "MIT": ["MIT License", "The MIT License (MIT)"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "GPL-3.0-only": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0-only": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0-only": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "AGPL-3.0-only": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "ISC": ["ISC License"],
}
#: What RULES name that is a notice, not a license.
NOTICES = ["All-Rights-Reserved"]
#: The colon of a tag ends no sentence.
TAG = r"(?i)(SPDX-License-Identifier):[ \t]*"

#: Where sentences end, and what normalisation takes for a space. The same in Java and RE2.
ENDS = r"[.!?;:]*[\n\r]+|[.!?;:]+[ \t]+"
NOISE = r"[^a-z0-9.]+"
#: Of ENDS, those that no sentence goes beyond; at the others, single line ends, a sentence may be wrapped.
STOPS = r"[.!?;:]+(?:[\n\r]+|[ \t]+)"
#: Each known sentence has one of these in it: texts without them need no look at their pieces.
SIGNS = ("licens", "software", "reserved", "redistribut", "cc0")


def normalised(sentence: str) -> str:
    """As the columns below do it, for the table of known sentences."""
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in sentence)
    return re.sub(NOISE, " ", low).strip(" .")


def known() -> dict[str, str]:
    """Identifiers by normalised sentence; one that splits is known by its parts of four words and more."""
    import re

    out: dict[str, str] = {}
    for name, variants in SENTENCES.items():
        for variant in variants:
            parts = [normalised(x) for x in re.split(ENDS, variant)]
            for part in parts:
                if len(parts) == 1 or part.count(" ") >= 3:
                    out.setdefault(part, name)
    return out


def declared() -> dict[str, list[str]]:
    """Sentences by identifier, made of tags, names and titles: a license is declared by its id, by its name or by a heading."""
    out = {f"Tag-{x}": [f"SPDX-License-Identifier {x}"] for x in TAGS}
    for x, names in NAMES.items():
        # The MIT License has been known in these words.
        out["MitReleased" if x == "MIT" else f"Project-{x}"] = [f"This {thing} is licensed under the {name}{where}" for thing in ("project", "software") for name in names for where in SAYS_WHERE]
    return out | {f"Title-{x}": titles for x, titles in TITLES.items()}


def all_rules() -> list[tuple[str, str, list[str]]]:
    """RULES and, after them, those for what is declared."""
    return [*RULES, *((f"declared {name}", name.split("-", 1)[1], [name]) for name in declared() if "-" in name)]


def published() -> dict[str, str]:
    """known() and the further sentences; identifiers have commas between them where a sentence stands for several."""
    whole = known() | {normalised(x): ",".join(names) for names, variants in PUBLISHED.items() for x in variants}
    for pair in (("Apache-2.0", "MIT"), ("MIT", "Apache-2.0")):
        whole[normalised(f"SPDX-License-Identifier {' OR '.join(pair)}")] = ",".join(f"Tag-{x}" for x in pair)
    return {normalised(x): name for name, variants in declared().items() for x in variants} | whole


def pieces(text: Column) -> Column:
    """The pieces of a text, with an empty one where a sentence can't go on; an array of an empty one for null."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), TAG, "$1 ")
    return F.split(F.regexp_replace(lines, STOPS, "\n\n"), "\n")


def identifiers(parts: Column, sentences: dict[str, str]) -> Column:
    """The identifiers of the known sentences in pieces, in order."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in sentences.items()))
    begins = F.lit("\n" + "".join(f"{k} \n" for k in sentences))
    none = F.array().cast("array<string>")

    def step(state: Column, piece: Column) -> Column:
        """open: the runs up to this piece that a known sentence begins with, the longest first. held: the identifiers
        of run, the last sentence found, which a longer one that it begins may still replace."""
        runs = F.concat(F.transform(state["open"], lambda r: F.concat(r, F.lit(" "), piece)), F.array(piece))
        live = F.filter(runs, lambda r: F.contains(begins, F.concat(F.lit("\n"), r, F.lit(" "))))
        after = lambda ids, held, run, open: F.struct(ids.alias("ids"), held.alias("held"), run.alias("run"), open.alias("open"))

        def settled(live: Column) -> Column:
            def hold(run: Column) -> Column:
                longer = (state["run"] != "") & F.startswith(run, F.concat(state["run"], F.lit(" ")))
                return after(
                    F.when(longer, state["ids"]).otherwise(F.concat(state["ids"], state["held"])), F.split(F.element_at(table, run), ","),
                    run, F.array(run),
                )

            found = F.transform(F.slice(F.filter(live, lambda r: F.try_element_at(table, r).isNotNull()), 1, 1), hold)
            return F.coalesce(F.get(found, F.lit(0)), after(state["ids"], state["held"], state["run"], live))

        return F.when(F.size(live) == 0, after(state["ids"], state["held"], state["run"], none)).otherwise(F.get(F.transform(F.array(live), settled), F.lit(0)))

    plain = F.transform(parts, lambda x: F.btrim(F.regexp_replace(ascii_lower(x), NOISE, " "), F.lit(" .")))
    return F.aggregate(
        plain, F.struct(none.alias("ids"), none.alias("held"), F.lit("").alias("run"), none.alias("open")), step,
        lambda s: F.concat(s["ids"], s["held"]),
    )


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None,
    rules: list[tuple[str, str, list[str]]] | None = None,
) -> DataFrame:
    """key, n_sentences long, sentence_ids array (in the order of the text), licenses and notices arrays (in the order of the rules).

    sentences: identifiers, with commas between them, by normalised() sentence (published() if left out); rules: as RULES, all_rules() if left out.
    """
    raw = docs.select(F.col(key), F.col(text).alias("_text"), pieces(F.col(text)).alias("_s"))
    ids = identifiers(F.col("_s"), sentences or published())
    if not sentences:
        low = ascii_lower(F.coalesce(F.col("_text"), F.lit("")))
        ids = F.when(reduce(or_, (F.contains(low, F.lit(x)) for x in SIGNS)), ids).otherwise(F.array().cast("array<string>"))
    counted = raw.select(F.col(key), F.size(F.filter("_s", lambda x: F.btrim(x) != "")).cast("long").alias("n_sentences"), ids.alias("sentence_ids"))
    found = counted.withColumn("_named", named("sentence_ids", rules or all_rules()))
    notice = lambda x: x.isin(NOTICES)
    return found.select(
        key, "n_sentences", "sentence_ids", F.filter("_named", lambda x: ~notice(x)).alias("licenses"), F.filter("_named", notice).alias("notices"),
    )


def named(ids: str, rules: list[tuple[str, str, list[str]]]) -> Column:
    """The licenses that rules name in a column of identifiers; each identifier stands in brackets of its own, so runs don't overlap by them."""
    whole = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    found: list[Column] = []
    left: dict[str, Column] = {}
    for family, license_id, run in rules:
        line, body = left.get(family, whole), F.lit("".join(f"<{x}>" for x in run))
        found.append(F.when(F.contains(line, body), license_id))
        left[family] = F.replace(line, body, F.lit("|"))
    return F.array_distinct(F.array_compact(F.array(*found)))


def oracle_sql() -> str:
    """The scan's digest in DuckDB SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known().items()) + "}"
    families: dict[str, list[str]] = {}
    said = [",".join(run) for _, name, run in RULES if name in NOTICES]
    for family, license_id, run in [x for x in RULES if x[1] not in NOTICES]:
        families.setdefault(family, []).append(f"WHEN contains(line, {quote(',' + ','.join(run) + ',')}) THEN {quote(license_id)}")
    cases = ", ".join(f"CASE {' '.join(x)} END" for x in families.values())
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
        WITH split AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{ENDS}') AS parts FROM documents),
        known AS (SELECT {table} AS m),
        named AS (
            SELECT doc_id, CAST(len(list_filter(parts, lambda x: trim(x) <> '')) AS BIGINT) AS n_sentences,
                array_to_string(list_filter(list_transform(parts, lambda x: m[trim(regexp_replace(translate(x, '{upper}', '{lower}'), '{NOISE}', ' ', 'g'), ' .')]), lambda x: x IS NOT NULL), ',') AS sentence_ids
            FROM split, known),
        lined AS (SELECT *, ',' || sentence_ids || ',' AS line FROM named)
        SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS licenses,
            CASE WHEN {" OR ".join(f"contains(line, ',{x},')" for x in said)} THEN '{NOTICES[0]}' ELSE '' END AS notices FROM lined
    """
