"""Versions of one licence are told apart, and identifiers and titles give their labels."""

import pytest

from scoreframe.llm import license_scan

INDEX = license_scan.build_index({}, 0)


def labels(text):
    return license_scan.scan(license_scan.words_of(text.encode()), INDEX)[0]


NOTICE = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(("name", "versions"), [
    ("General Public License", {"1": set(), "2": {"gpl-2"}, "3": {"gpl-3"}}), ("Lesser General Public License", {"2": set(), "2.0": set(), "2.1": {"lgpl-2.1"}, "3": {"lgpl-3"}}),
    ("Library General Public License", {"2": {"lgpl-2"}, "3": set()}), ("Affero General Public License", {"1": set(), "2": set(), "3": {"agpl-3"}}),
])
def test_gnu_versions(name, versions):
    for version, want in versions.items():
        assert labels(NOTICE.format(name, ";", version)) == want and labels(NOTICE.format(name, ",", version)) == want
        assert labels(f"It is licensed under the GNU {name} version {version} of its authors.") == want


@pytest.mark.parametrize(("text", "want"), [
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", {"ofl-1.1"}), ("This Font Software is licensed under the SIL Open Font License, Version 1.0.", set()),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2"}), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", set()),
    ("made available under the terms of the Eclipse Public License v2.0", set()), ("made available under the terms of the Eclipse Public License v. 2.0", {"epl-2"}), ("made available under the terms of the Eclipse Public License v. 1.0", set()),
    ("Licensed under CC BY 4.0", {"cc-by"}), ("Licensed under CC BY 3.0", set()), ("licensed under the Artistic License 1.0", set()), ("licensed under the Artistic License 2.0", {"artistic-2"}),
    ("Licensed under a Creative Commons Attribution-ShareAlike 3.0 International License", set()), ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", {"cc-by-sa"}),
    ("The MIT License (MIT)\n\nCopyright (c) 2020", {"mit"}), ("MIT License\n\nCopyright (c) 2020 A B", {"mit"}), ("a mit glove", set()),
])
def test_other_versions_and_titles(text, want):
    assert labels(text) == want


def test_spdx_lines():
    for name, label in license_scan.SPDX.items():
        assert label in labels(f"// SPDX-License-Identifier: {name}\nint main") and labels(f"// SPDX-License-Identifier: {name}-or-later").issuperset({label})
    assert labels("SPDX-License-Identifier: LGPL-2.0") == {"lgpl-2"} and labels("SPDX-License-Identifier: GPL-1.0") == set() and labels("SPDX-License-Identifier: BSD-3-Clause") == {"bsd-3"}
