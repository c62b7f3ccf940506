"""Labelled pages for the weights of main-text extraction.

Layouts written for this purpose: ``[n]`` stands for n words of text, elements of the main
text carry ``data-keep``. They cover pages with and without semantic elements.
"""

from __future__ import annotations

import re

LINKS = "<ul>" + "<li><a href=#>[1]</a></li>" * 6 + "</ul>"
TEASERS = "<div>" + "<h3><a href=#>[6]</a></h3><div>[9]</div>" * 3 + "</div>"
PROSE = "<p data-keep>[45]</p><p data-keep>[60] <a href=#>[3]</a> [20]</p><h2 data-keep>[5]</h2><p data-keep>[80]</p>"
LISTED = "<p data-keep>[40]</p><ul data-keep><li>[12]</li><li>[15]</li><li>[9]</li></ul><p data-keep>[50]</p>"
TABLE = "<p data-keep>[35]</p><table data-keep><tr><td>[3]</td><td>[2]</td></tr><tr><td>[4]</td><td>[2]</td></tr></table>"
QUOTE = "<blockquote data-keep><p>[25]</p></blockquote><p data-keep>[40]</p><p data-keep>[4]</p>"

LAYOUTS = [
    "<body><nav>{links}</nav><article><h1 data-keep>[7]</h1>{text}</article><footer>[8]</footer>",
    "<body><header>{links}</header><main><h1 data-keep>[6]</h1>{text}</main><div>[9]</div>{links}",
    "<body><div>{links}</div><h1 data-keep>[8]</h1>{text}<div>{links}</div><div>[7]</div>",
    "<body><table><tr><td>{links}</td><td><h1 data-keep>[6]</h1>{text}</td></tr></table><div>[10]</div>",
    "<body><div>[3] <a href=#>[2]</a> [1] <a href=#>[2]</a></div><div>{text}</div>{teasers}<div><a href=#>[2]</a> <a href=#>[2]</a></div>",
    "<body>{links}<article><h1 data-keep>[5]</h1>{text}</article>{teasers}<div>[14]</div>",
    "<body><div>[6]</div><div class=content><h1 data-keep>[7]</h1>{text}</div><div>{links}</div>",
    "<body><div>{links}{links}</div>{teasers}<div><div data-keep>[55]</div><div data-keep>[70]</div></div><div>{links}</div>",
]


def pages() -> list[str]:
    texts = [PROSE, LISTED, TABLE, QUOTE, PROSE + QUOTE, LISTED + PROSE]
    found = [
        layout.format(links=LINKS, teasers=TEASERS, text=text) for layout in LAYOUTS for text in texts
    ]
    return [re.sub(r"\[(\d+)\]", lambda m: " ".join(["word"] * int(m[1])), page) for page in found]
