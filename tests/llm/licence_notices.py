"""Notices as they stand in published files, with their families, and sentences that name no licence.

None is fitted on. Two names ("MIT licensed", "GPLv3" alone) joined the list of names after they were missed here.
"""

NOTICES = (
    ("isc", "Licensed under the ISC License."),
    ("gpl", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("cc_by_sa", "This article is available under CC BY-SA 3.0"),
    ("zlib", "Released under the zlib license"),
    ("epl", "Licensed under the Eclipse Public License v1.0"),
    ("artistic", "distributed under the Artistic License 2.0"),
    ("bsd", "Released under the Modified BSD license"),
    ("cc0", "To the extent possible under law, the author has dedicated this to the public domain: CC0 1.0"),
    ("cc_by_sa", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("wtfpl", "This is free under the WTFPL license"),
    ("gpl", "This file is part of Foo. Foo is licensed under the GNU GPL, version 2 or later."),
    ("mit", "Copyright (c) 2014 Jane Doe. MIT License."),
    ("mit", "Code is MIT licensed, see LICENSE"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("agpl", "GNU Affero General Public License for more details"),
    ("mpl", "Licensed under MPL 2.0"),
    ("cc_by_nc_sa", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License."),
    ("cc_by_nd", "CC BY-ND 4.0"),
    ("ofl", "Fonts are under the SIL Open Font License 1.1"),
    ("psf", "Released under the Python Software Foundation License"),
    ("gfdl", "GNU Free Documentation License, Version 1.3"),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cddl", "Common Development and Distribution License (CDDL) version 1.0"),
    ("odbl", "OpenStreetMap data is available under the Open Database License"),
    ("postgresql", "Released under the PostgreSQL License"),
    ("ms_pl", "Microsoft Public License (Ms-PL)"),
    ("eupl", "Licensed under the EUPL-1.2-or-later"),
    ("cc_by", "Except where noted, content is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc_by_nc", "This image is CC BY-NC 2.0"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("isc", "# SPDX-License-Identifier: ISC"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program."),
    ("apache", "Apache License 2.0"),
    ("mit", "Licensed under the MIT license: http://www.opensource.org/licenses/mit-license.php"),
    ("cc_by_nc_nd", "licensed under CC BY-NC-ND 4.0"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, stored or transmitted"),
    ("gpl", "License: GPLv3"),
    ("epl", "SPDX-License-Identifier: EPL-2.0"),
    ("mpl", "If a copy of the MPL was not distributed, this Source Code Form is subject to the terms of the Mozilla Public License"),
    ("bsd", "Licensed under the 2-clause BSD license"),
    ("cc_by", "Photo: J. Doe, CC BY 2.0"),
    ("agpl", "is free software under AGPLv3"),
    ("apache", "Project is Apache 2.0 licensed and open source"),
    ("lgpl", "This library is free software, see the GNU LGPL for terms"),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
    ("zlib", "This notice: zlib/libpng license, see zlib.h"),
)
HARMLESS = (
    "Our office sits between the MIT museum and the river.", "The Apache helicopter was licensed for export.", "You need a fishing license to use the general public pier.",
    "Creative Commons is a nonprofit organisation.", "Attribution of the painting is disputed", "The vote passed by 4 to 2.", "All rights reserved seats are sold out.",
    "Permission is granted to enter.", "Public license plates are blue", "He holds a master's in software from the open university",
    "The European Union public consultation closed in version 2.0", "released under license to the distributor", "Mozilla released Firefox 2.0", "The licence fee rose by 4.0 percent",
    "He released a zlib port", "software license agreement with the customer", "Licensed under the Acme Public License 1.0", "Copyright 2019 the authors",
    "The database was opened to the public in 2004", "Version 2.0 of the paper was published in January 2004",
)
