"""Templates of the licence scan."""

from logspark.llm.license_scan import Template

# Phrases and their labels.
PHRASES = [
    Template("cc-by", "cc by", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("reserved", "all rights reserved", phrase=True),
]

# Wording of public licence notices and their labels.
NOTICES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License"),
    Template("mit", "Released under the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template(
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc0", "The person who associated a work with this deed has dedicated the work to the public domain"),
]

TEMPLATES = [*PHRASES, *NOTICES]
