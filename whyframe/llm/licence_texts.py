"""What the licence classifier learns from: names and notices of licence families, and plain prose.

All of it is short public wording; longer training texts are put together from
lead-ins and names by rule.
"""

from __future__ import annotations

import re

NAMES: dict[str, list[str]] = {
    "mit": ["MIT License", "MIT licence", "X11 License"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL 2.0", "GNU General Public License as published by the Free Software Foundation; version 2"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL 3.0", "GNU General Public License as published by the Free Software Foundation; version 3"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3", "GNU LGPL"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "Simplified BSD License", "Modified BSD License", "BSD license"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "isc": ["ISC License", "Internet Systems Consortium license"],
    "unlicense": ["Unlicense", "The Unlicense"],
    "cc0": ["CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0 public domain dedication"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 3.0"],
    "cc-by-nd": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "eupl": ["European Union Public Licence", "EUPL 1.2"],
}

LEAD_INS = [
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "This work is licensed under the {}.",
    "This work is licensed under {}.",
    "This software is distributed under the terms of the {}.",
    "Published under a {}.",
    "Available under the {}; see the file for details.",
    "The code in this repository is free software under the {}.",
    "Content is available under {} unless otherwise noted.",
    "{}",
]

NOTICES: dict[str, list[str]] = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org.",
    ],
    "gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."],
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2019 Example Corporation. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
        "(c) 2021 the authors, all rights reserved worldwide.",
        "This software is proprietary; unauthorised copying is prohibited.",
    ],
}

#: Prose with words of licences that grants or keeps nothing.
PROSE = [
    "He renewed his driving license at the town hall.",
    "The bar lost its licence to serve beer after midnight.",
    "Civil rights were at the heart of the public debate.",
    "The general told the public that version two of the story was false.",
    "She reserved a table for six and was free after eight.",
    "Poets take a certain license with the truth.",
    "The foundation published its first report on free schools.",
    "Customers have the right to copy their own data.",
    "The work was done under the supervision of the mayor.",
    "Students at MIT built a small satellite.",
    "The Apache helicopter landed near the village.",
    "A warranty covers the engine for two years.",
    "The union of European states met in public.",
    "The commons are creative places where people meet.",
    "Permission to enter the building was granted at noon.",
    "The software crashed when the file was opened.",
    "All seats are reserved for members.",
    "The law of the land applies to all persons.",
    "Copyright law was the subject of the lecture.",
    "The contributors met to promote their products.",
]


def examples() -> list[tuple[str, str]]:
    """(family, paragraph) by rule from names, lead-ins and notices."""
    out = [(family, lead.format(name)) for family, names in NAMES.items() for name in names for lead in LEAD_INS]
    for family, texts in NOTICES.items():
        for text in texts:
            out += [(family, text)] * 3
            parts = text.replace(";", ",").split(", ")
            out += [(family, ", ".join(parts[:k])) for k in range(2, len(parts))]
    return out


def unknown_examples() -> list[tuple[str, str]]:
    """("unknown", paragraph): licence wording that tells no family.

    Names lose the words that fewer than a third of the families have; notices
    keep every second word, so that no pair of theirs stays.
    """
    words = lambda text: [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    held = {f: {w for t in ts for w in words(t)} for f, ts in templates().items()}
    common = {w for ws in held.values() for w in ws if 3 * sum(w in other for other in held.values()) >= len(held)}
    out = []
    for name in sorted({n for names in NAMES.values() for n in names}):
        left = [w for w in words(name) if w in common]
        if {"license", "licence"} & {*left} and len(left) < len(words(name)):
            out += [("unknown", lead.format(" ".join(left))) for lead in LEAD_INS]
    for texts in NOTICES.values():
        for text in texts:
            if len(words(text)) >= 8:
                out += [("unknown", " ".join(words(text)[k::2])) for k in (0, 1)]
    return out


def templates() -> dict[str, list[str]]:
    """For each family the texts that confirm it."""
    return {f: NAMES.get(f, []) + NOTICES.get(f, []) for f in {**NAMES, **NOTICES}}
