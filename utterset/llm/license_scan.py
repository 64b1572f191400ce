"""License scan: which license notices a text holds, and where.

Templates are retrieved by MinHash bands over overlapping windows of the text (and over
the whole text, for notices that are spread over it), and verified by exact shingle
containment.

Edge cases: as in ``containment``; a template table with no words finds nothing. A
template of fewer than five words is found as an exact word sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .containment import contained

CREATIVE_COMMONS = [
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]
SPDX = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "Unlicense", "CC0-1.0", *[f"CC-{short}-4.0" for short, _ in CREATIVE_COMMONS],
        *[f"{name}-{which}" for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for which in ("only", "or-later")]]

# Notices, openings and main paragraphs of widely used licenses, as their publishers word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
            "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                   "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, "
                   "non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly "
                   "display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
            "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                 "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this "
                "software to the public domain worldwide. This software is distributed without any warranty."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as "
                  "a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    # Short and long notices of the CC family (the long ones of BY and BY-SA are above).
    *[(f"CC-{short}-4.0", f"Licensed under CC {short} 4.0.") for short, _ in CREATIVE_COMMONS],
    *[(f"CC-{short}-4.0", f"CC {short} 4.0") for short, _ in CREATIVE_COMMONS],
    *[(f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License.") for short, name in CREATIVE_COMMONS[2:]],
    *[(name, f"SPDX-License-Identifier: {name}") for name in SPDX],
]


def templates(spark: SparkSession) -> DataFrame:
    """``(template_id, license, text)`` of the built-in notices."""
    rows = [(i, name, text) for i, (name, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template_id int, license string, text string")


def license_scan(docs: DataFrame, notices: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``(doc_id, template_id, license, containment, first_word, last_word)`` for every
    document and notice (``notices``: template_id, license, text) found in it."""
    found = contained(docs.select("doc_id", "text"), notices.select("template_id", "text"), "doc_id", "template_id", threshold, windowed=True)
    return found.join(notices.select("template_id", "license").distinct(), "template_id") \
        .select("doc_id", "template_id", "license", "containment", "first_word", "last_word")
