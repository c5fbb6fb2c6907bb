"""An independent reading of pages with the standard library's tokenizer (tests only)."""

from html.parser import HTMLParser

BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
HIDDEN = {"noscript", "header", "footer", "nav", "svg", "template", "iframe"}


def clean(text):
    return " ".join(text.split())


class Reader(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.paragraphs, self.links, self.headings, self.visible = [], [], [], []
        self.open_p = self.open_a = self.open_h = self.raw = None
        self.hidden = []
        self.feed(html)
        self.close()
        self.end_p()
        self.end_a()
        self.end_h()

    def end_p(self):
        if self.open_p is not None:
            self.paragraphs.append(clean("".join(self.open_p)))
        self.open_p = None

    def end_a(self):
        if self.open_a is not None:
            href, text = self.open_a
            self.links.append((clean("".join(text)), href))
        self.open_a = None

    def end_h(self):
        if self.open_h is not None:
            self.headings.append((self.open_h[0], clean("".join(self.open_h[1]))))
        self.open_h = None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_p()
        if tag == "p":
            self.open_p = []
        if tag == "a":
            self.end_a()
            self.open_a = (dict(reversed(attrs)).get("href"), [])
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.end_h()
            self.open_h = (tag, [])
        if tag in ("script", "style"):
            self.raw = tag
        if tag in HIDDEN:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_p()
        if tag == "a":
            self.end_a()
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.end_h()
        if tag == self.raw:
            self.raw = None
        if tag in HIDDEN and tag in self.hidden:
            while self.hidden.pop() != tag:
                pass

    def handle_data(self, data):
        if self.raw:
            return
        for target in (self.open_p, self.open_a and self.open_a[1], self.open_h and self.open_h[1]):
            if target is not None:
                target.append(data)
        if not self.hidden:
            self.visible.append(data)


def ordered(items):
    return list(dict.fromkeys(items))
