"""Trains the block labeller of ``html_extract`` on generated pages.

    python -m leafmill.llm.html_train [pages] [epochs]

``page(rng)`` makes a page of a random layout whose every text run starts with a marker
that says whether it is main text; the parser's blocks then carry their own labels. The
seed is fixed and nothing else is read, so the weights can be made again.
"""

from __future__ import annotations

import sys

import numpy as np

from leafmill.llm.html_extract import HIDDEN, MEASURES, PATH_SIZE, WEIGHTS, WORD_SIZE, blocks_of, cell, scores, vectors

MAIN, OTHER = "\ue001", "\ue000"
#: Syllables and common words for invented prose in four languages.
SYLLABLES = {
    "en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(),
    "fr": "es le de en re nt on er te et ou ai el an qu me ion eau ieux ment é è ê ç".split(),
    "de": "en er ch de ei ie in te ge un st be ver ung keit heit ü ö ä ß sch".split(),
    "es": "de la en ar os el es er que ción ad ta ro ñ ó í mente ez".split(),
}
COMMON = {
    "en": "the of and to in is that for it with was on as be by this".split(),
    "fr": "le la de et les des en un du une que est pour dans".split(),
    "de": "der die und in den von zu das mit sich des auf für ist".split(),
    "es": "de la que el en y a los se del las un por con".split(),
}
#: Phrases of page furniture.
FURNITURE = (
    "Home|About us|Contact|Privacy policy|Terms of use|Subscribe to our newsletter|Sign up|Log in|Search|Menu|Next page|Older posts|"
    "Share this|Tweet|Read more|Related articles|Most popular|We use cookies to improve your experience.|Accept all|Advertisement|"
    "Sponsored|All rights reserved.|Copyright 2024|Follow us|Back to top|Tags|Categories|Archive|Leave a reply|Comments|Reply|Report|"
    "Accueil|Mentions légales|Nous utilisons des cookies.|Tous droits réservés|Connexion|Rechercher|Commentaires|Répondre|Publicité|"
    "Startseite|Impressum|Datenschutz|Wir verwenden Cookies.|Alle Rechte vorbehalten|Anmelden|Suche|Kommentare|Antworten|Anzeige|"
    "Inicio|Aviso legal|Usamos cookies.|Todos los derechos reservados|Entrar|Buscar|Comentarios|Responder|Publicidad"
).split("|")


#: Lines of licences and the like, which articles hold too.
LINES = (
    "Licensed under CC BY-NC 4.0.|Licensed under CC BY-SA 4.0.|Licensed under the Apache License, Version 2.0.|"
    "This work is licensed under the GNU General Public License, version 3.|Released under the MIT License."
).split("|")


class Page:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.lang = self.one(list(SYLLABLES))
        self.mark = OTHER

    def one(self, items):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        if self.chance(0.35):
            return self.one(COMMON[self.lang])
        return "".join(self.one(SYLLABLES[self.lang]) for _ in range(int(self.rng.integers(1, 5))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(low, high + 1))))

    def prose(self, most: int = 6) -> str:
        n = int(self.rng.integers(1, most + 1))
        if self.chance(0.12):
            return self.one(LINES)
        style = self.one(["", "", "", "", "***", "!!", " |"])
        text = " ".join(self.words(2, 18).capitalize() + "." for _ in range(n))
        if style:
            text = " ".join(w + style for w in text.split())
        text = text.replace("&", "&amp;")
        if self.chance(0.12):
            number = str(int(self.rng.integers(10**9, 10**14)))
            odd = [number, f"+1 ({number[:3]}) {number[3:6]}-{number[6:9]}", ".".join(number[i : i + 2] for i in (0, 2, 4, 6)),
                   f"{self.word()}@{self.word()}.example.org", f'token = "{int(number):040x}"', f"https://{self.word()}.example.com/{number[:4]}"]
            text = text.replace(" ", f" {self.one(odd)} ", 1) + " " + self.words(1, 5)
        if self.chance(0.15):
            text = text.replace(" ", " <b>", 1) + ("</b>" if self.chance(0.7) else "")
        if self.chance(0.1):
            text += ' <a href="/x">' + self.words(1, 3) + "</a> " + self.words(2, 8) + "."
        return text

    def furniture(self) -> str:
        return self.one(FURNITURE) if self.chance(0.6) else self.words(1, 4)

    def t(self, text: str) -> str:
        return self.mark + text

    def el(self, tag: str, inner: str, hint: str = "") -> str:
        return f"<{tag}{hint}>{inner}</{tag}>"

    def hint(self, *names: str) -> str:
        """A class or id from ``names``, now and then with other parts, or none."""
        if self.chance(0.12):
            return ""
        name = self.one(list(names))
        if self.chance(0.3):
            name += self.one([" wide", "-box", " row", "-2", "_main", " block", "-wrapper", " clearfix"])
        return f' {self.one(["class", "class", "id"])}="{name}"'

    def links(self, low: int = 2, high: int = 9) -> str:
        n = int(self.rng.integers(low, high + 1))
        items = [f'<a href="/{i}">{self.t(self.furniture())}</a>' for i in range(n)]
        if self.chance(0.7):
            return self.el("ul", "".join(self.el("li", x) for x in items))
        return self.one(["", " | ", " "]).join(items) if self.chance(0.5) else "".join(self.el("div", x) for x in items)

    def nav(self) -> str:
        return self.el("nav", self.links()) if self.chance(0.6) else self.el("div", self.links(), self.hint("nav", "menu", "navigation", "topbar"))

    def header(self) -> str:
        inner = self.el(self.one(["h1", "div", "p"]), self.t(self.words(1, 3).title()))
        if self.chance(0.5):
            inner += self.el("p", self.t(self.words(3, 9)))
        if self.chance(0.4):
            inner += self.nav()
        return self.el("header", inner) if self.chance(0.6) else self.el("div", inner, self.hint("header", "masthead", "banner", "site-header"))

    def ad(self) -> str:
        text = self.t(self.prose(3))
        inner = text if self.chance(0.7) else self.el("p", text)
        return self.el(self.one(["div", "div", "div", "aside", "section", "ins"]), inner, f' class="{self.one(["ad", "ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"])}"')

    def notice(self) -> str:
        inner = self.el("p", self.t(self.one(FURNITURE) + " " + self.prose(2)))
        if self.chance(0.6):
            inner += self.el("button", self.t(self.furniture()))
        return self.el("div", inner, f' {self.one(["class", "id"])}="{self.one(["notice", "cookie", "cookie-notice", "consent", "alert", "popup", "gdpr", "cookie-banner", "modal"])}"')

    def form(self) -> str:
        inner = self.el("label", self.t(self.furniture())) + '<input name="q">' + self.el("button", self.t(self.furniture()))
        if self.chance(0.4):
            inner = self.el("p", self.t(self.prose(2))) + inner
        if self.chance(0.3):
            inner += self.el("select", "".join(self.el("option", self.t(self.words(1, 2))) for _ in range(3)))
        if self.chance(0.2):
            inner += self.el("textarea", self.t(self.words(1, 6)))
        return self.el("form", inner, self.hint("search", "newsletter", "login", "signup"))

    def sidebar(self) -> str:
        inner = ""
        for _ in range(int(self.rng.integers(1, 4))):
            inner += self.el("h3", self.t(self.furniture())) + self.one([self.links, lambda: self.el("p", self.t(self.prose(3)))])()
        return self.el("aside", inner) if self.chance(0.5) else self.el("div", inner, f' class="{self.one(["sidebar", "side", "widget", "rail", "related", "right-column", "sidebar-left"])}"')

    def comments(self) -> str:
        out = self.el(self.one(["h2", "h3", "h4"]), self.t(self.one(FURNITURE)))
        for _ in range(int(self.rng.integers(1, 8))):
            who, said = self.t(self.words(1, 2).title()), self.t(self.prose(4))
            body = (self.el(self.one(["span", "p", "cite", "div", "b"]), who, self.one(["", ' class="author"'])) if self.chance(0.8) else "") + (self.el("p", said) if self.chance(0.7) else said)
            out += self.el(self.one(["li", "div", "article", "div"]), body, self.one(["", ' class="comment"', ' class="reply"', ' class="comment-body"']))
        if self.chance(0.4):
            out += self.form()
        return self.el(self.one(["section", "div", "ol", "div"]), out, f' {self.one(["class", "id"])}="{self.one(["comments", "comment-list", "responses", "discussion", "disqus", "user-comments", "reader-comments"])}"')

    def footer(self) -> str:
        inner = self.t(f"&copy; {self.words(1, 2)} &middot; {self.words(3, 14)}.")
        if self.chance(0.5):
            inner = self.el("p", inner)
        if self.chance(0.4):
            inner += self.links()
        return self.el("footer", inner) if self.chance(0.7) else self.el("div", inner, f' {self.one(["class", "id"])}="{self.one(["footer", "site-footer", "bottom", "copyright"])}"')

    def body(self) -> str:
        self.mark = MAIN
        out = [self.el(self.one(["h1", "h1", "h1", "h2"]), self.t(self.words(1, 12).capitalize() + self.one(["", "", "."])))] if self.chance(0.85) else []
        for _ in range(int(self.one([1, 2, 4, 8, 15, 30]) * (0.5 + self.rng.random())) + 1):
            kind = self.rng.random()
            if kind < 0.72:
                text = self.t(self.words(1, 2).capitalize() + "." if self.chance(0.15) else self.prose(self.one([1, 3, 6, 12])))
                shape = self.rng.random()
                out.append(f"<p>{text}" + ("</p>" if shape < 0.75 else "<br>" if shape < 0.9 else ""))
            elif kind < 0.78:
                out.append(self.el(self.one(["h2", "h3"]), self.t(self.words(1, 6).capitalize())))
            elif kind < 0.84:
                out.append(self.el(self.one(["ul", "ol"]), "".join(self.el("li", self.t(self.words(1, 14))) for _ in range(3))))
            elif kind < 0.88:
                out.append(self.el("blockquote", self.el("p", self.t(self.prose(3)))))
            elif kind < 0.91:
                out.append(self.el("table", "".join(self.el("tr", "".join(self.el("td", self.t(self.words(1, 4))) for _ in range(3))) for _ in range(3))))
            elif kind < 0.93:
                out.append(self.el(self.one(["pre", "div"]), self.t(self.prose(3))))
            else:
                self.mark = OTHER
                out.append(self.one([self.ad, self.ad, self.form, self.sidebar, self.notice, self.nav, lambda: self.el("div", self.links(), ' class="share"')])())
                self.mark = MAIN
        self.mark = OTHER
        if self.chance(0.15):  # what follows the text may stand inside the same container
            out.append(self.one([self.comments, self.comments, self.form, self.ad, self.footer])())
        inner = "".join(out)
        return self.one(
            [
                lambda: self.el("article", inner),
                lambda: self.el("article", inner, self.hint("post", "story", "entry")),
                lambda: self.el("main", self.el("article", inner)),
                lambda: self.el("main", inner),
                lambda: self.el("div", inner, self.hint("content", "article", "post", "entry-content", "story-body", "text", "main")),
                lambda: self.el("section", inner, self.hint("content", "article", "story")),
                lambda: self.el("table", self.el("tr", self.el("td", self.links()) + self.el("td", inner))),
            ]
        )()

    def html(self) -> str:
        parts = []
        for make, p in ((self.notice, 0.15), (self.header, 0.4), (self.nav, 0.7), (self.form, 0.15), (self.ad, 0.5), (self.sidebar, 0.2), (self.notice, 0.1)):
            if self.chance(p):
                parts.append(make())
        parts.append(self.body())
        for make, p in ((self.ad, 0.2), (self.comments, 0.4), (self.sidebar, 0.3), (self.form, 0.15), (self.nav, 0.1), (self.footer, 0.85), (self.notice, 0.1)):
            if self.chance(p):
                parts.append(make())
        title = self.el("title", self.t(self.words(2, 9))) + "<style>p{margin:0}</style><script>var t=\"</p>\";</script>"
        inner = self.one(["", "", "<!-- x -->"]).join(parts)
        if self.chance(0.3):
            inner = self.el("div", inner, self.hint("page", "wrapper", "container"))
        return f"<!DOCTYPE html><html><head>{title}</head><body>{inner}" + ("</body></html>" if self.chance(0.9) else "")


def example(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The block vectors and labels of one page."""
    blocks = blocks_of(Page(rng).html())
    kept, labels = [], []
    for b in blocks:
        marks = {c for c in b.text if c in (MAIN, OTHER)}
        b.text = " ".join(b.text.replace(MAIN, "").replace(OTHER, "").split())
        if len(marks) == 1 and b.text:
            kept.append(b)
            labels.append(MAIN in marks)
    return vectors(kept), np.array(labels, np.float32)


def forward(x, w, u, b, live):
    """States of one direction over x (time, batch, inputs), and what ``backward`` needs; ``live`` masks padding."""
    h = c = np.zeros((x.shape[1], u.shape[0]), x.dtype)
    given, out, kept = x @ w + b, [], []
    for t in range(len(x)):
        i, f, o, g, new_c, tanh_c = cell(given[t] + h @ u, c)
        kept.append((h, c, i, f, o, g, tanh_c))
        h, c = live[t] * (o * tanh_c) + (1 - live[t]) * h, live[t] * new_c + (1 - live[t]) * c
        out.append(h)
    return np.stack(out), kept


def backward(x, w, u, kept, live, d_out):
    """Gradients of one direction for d_out = d loss / d states."""
    steps, batch, _ = x.shape
    size = u.shape[0]
    dz = np.zeros((steps, batch, 4 * size), x.dtype)
    dh, dc = np.zeros((batch, size), x.dtype), np.zeros((batch, size), x.dtype)
    du = np.zeros_like(u)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tanh_c = kept[t]
        m = live[t]
        dh = dh + d_out[t]
        h_in, c_in = m * dh, m * dc
        d_new_c = c_in + h_in * o * (1 - tanh_c**2)
        dz[t] = np.concatenate(
            [d_new_c * g * i * (1 - i), d_new_c * c * f * (1 - f), h_in * tanh_c * o * (1 - o), d_new_c * i * (1 - g**2)], axis=1
        )
        du += h.T @ dz[t]
        dh, dc = (1 - m) * dh + dz[t] @ u.T, (1 - m) * dc + d_new_c * f
    return np.tensordot(x, dz, ([0, 1], [0, 1])), du, dz.sum((0, 1))


def train(n_pages: int = 3000, epochs: int = 5, seed: int = 9) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    pages = [p for p in (example(rng) for _ in range(n_pages)) if len(p[1])]
    size, inputs = HIDDEN, PATH_SIZE + WORD_SIZE + MEASURES
    q = {}
    for d in "fb":
        q["w" + d] = rng.normal(0, 0.1, (inputs, 4 * size))
        q["u" + d] = rng.normal(0, 0.15, (size, 4 * size))
        q["b" + d] = np.concatenate([np.zeros(size), np.ones(size), np.zeros(2 * size)])
    q["wo"], q["bo"] = rng.normal(0, 0.1, (2 * size, 1)), np.zeros(1)
    q = {k: v.astype(np.float32) for k, v in q.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in q.items()}, {k: np.zeros_like(v) for k, v in q.items()}, 0
    for epoch in range(epochs):
        order = sorted(range(len(pages)), key=lambda i: (len(pages[i][1]) // 8, rng.random()))
        batches = [order[k : k + 32] for k in range(0, len(order), 32)]
        rng.shuffle(batches)
        loss = 0.0
        for part in batches:
            steps = max(len(pages[i][1]) for i in part)
            x = np.zeros((steps, len(part), inputs), np.float32)
            y, live = np.zeros((steps, len(part), 1), np.float32), np.zeros((steps, len(part), 1), np.float32)
            for k, i in enumerate(part):
                n = len(pages[i][1])
                x[:n, k], y[:n, k, 0], live[:n, k] = pages[i][0], pages[i][1], 1
            drop = (rng.random((1, len(part), PATH_SIZE)) > 0.05).astype(np.float32)
            x[:, :, :PATH_SIZE] *= drop
            hf, kf = forward(x, q["wf"], q["uf"], q["bf"], live)
            hb, kb = forward(x[::-1], q["wb"], q["ub"], q["bb"], live[::-1])
            both = np.concatenate([hf, hb[::-1]], axis=2)
            p = 1 / (1 + np.exp(-(both @ q["wo"] + q["bo"])))
            n = live.sum()
            loss -= float((live * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
            d = live * (p - y) / n
            g = {"wo": np.tensordot(both, d, ([0, 1], [0, 1])), "bo": d.sum((0, 1))}
            d_both = d @ q["wo"].T
            g["wf"], g["uf"], g["bf"] = backward(x, q["wf"], q["uf"], kf, live, d_both[:, :, :size])
            g["wb"], g["ub"], g["bb"] = backward(x[::-1], q["wb"], q["ub"], kb, live[::-1], d_both[::-1, :, size:])
            step += 1
            rate = 0.006 * (1 - step / (epochs * len(batches) + 1))
            norm = max(1.0, float(np.sqrt(sum((v**2).sum() for v in g.values()))))
            for k in q:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k] / norm
                m2[k] = 0.99 * m2[k] + 0.01 * (g[k] / norm) ** 2
                q[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
        print(f"epoch {epoch}: loss {loss / len(batches):.4f}", flush=True)
    return q


def accuracy(q: dict[str, np.ndarray], n_pages: int = 500, seed: int = 10) -> tuple[float, float]:
    """Shares of blocks, and of whole pages, labelled right, on other pages of the generator."""
    rng = np.random.default_rng(seed)
    pages = [example(rng) for _ in range(n_pages)]
    right = [(p >= 0.5) == (y > 0) for p, (_, y) in zip(scores([x for x, _ in pages], q), pages, strict=True)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    made = train(*(int(a) for a in sys.argv[1:]))
    print("blocks right, pages right:", accuracy(made))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in made.items()})
