"""Small labelled table of page lines, written by hand, and the training pages made from it.

The table gives lines by the part of a page they stand in. ``{N}`` stands for a name, ``{n}`` for
a noun, ``{a}`` for an adjective and ``{d}`` for a number. Training pages put lines together the
way pages are laid out, with invented words for the placeholders.
"""

from __future__ import annotations

import random
import re

#: Parts whose lines belong to the article; those of all other parts belong to the site.
ARTICLE = {"paragraph", "heading", "item"}

NEWS = {
    "sections": """Home;News;Sport;Money;Business;Health;Education;Science;Innovation;Live;Video;Audio;Travel;Weather
        Culture;Politics;Local;Earth;Arts;World;Newsbeat;In Pictures""",
    "top": """Skip to main content;Skip to content;Accessibility links;Jump to the story;Northbeacon Homepage
        Sign in;Search Northbeacon;Your account;More menu;Register   Sign In   Notifications;Notifications;Register""",
    "notice": """We and our partners use cookies so that adverts fit your interests.
        Your privacy matters to us and similar technologies. Let us know if you agree.
        By continuing to browse you agree to our use of cookies to remember your settings. Yes, I agree / No, take me to settings.
        This site stores small files on your device to measure how our pages are read.
        Cookies help us to give you the best online experience. Manage my settings.
        Northbeacon uses cookies and similar technologies. Accept all.
        Let us know if you agree;Accept all;Reject additional cookies;Manage my settings;Find out more
        Yes, I agree / No, take me to settings""",
    "paragraph": """The {a} {n} was opened in May {d}, and the first {n} came in before the {n}. Later, the {n} of {N} thanked the {n}.
        The {a} {n} crossed the {n} behind the {n}, although {N} {N} kept the {n}. In the same week, a {n} found the {n}.
        Every {a} {n} named the {n} with {d} {n}s, but the {n} sold the {n} of {N}.
        At first, this {a} {n} asked the {n} for a {n}, because the {n} and the {n} had crossed the {n} in March {d}. As a result, {N} {N} left.
        One {a} {n} near the {n} was sold to the {n}. For several years, the {n} kept one {n} behind the {a} {n}.
        Shares of the {N} {n} closed at {d}.{d} on the {N} exchange, after {d} days of {a} trading.
        Readers of the old newsletter were told to sign up again by the {n} of {N}.
        The advertisement for the {n} ran for {d} years in {N}.
        The committee wants a law on cookies and asks every {n} to say “accept all” less often.
        “Follow us,” shouted the {n}, and the crowd of {N} shared the video.
        Home in {N}, the {n} said the news and sport pages had become too short.
        The {n} owns the copyright and has reserved all rights, said {N} {N}.""",
    "heading": """‘Nobody asked us’;How did it start?;What happens next?;Three years on;A slow recovery;Analysis;Background
        Who pays for it?;The cost of waiting;A second opinion;‘We did not expect this’;The {a} {n};Why now?;A {a} {n}""",
    "item": """- two more like the {n}, still missing;- one {n}, found near {N};{N} {N} (right) with the {n} of {N}
        The {n} (left) of {N};A {a} {n} near {N}""",
    "inline": """Advertisement;ADVERTISEMENT;Article continues below this advert;Share page: Email, Message, Copy link;Share
        Share this article Email Copy link;Share - About sharing;Share page;Copy this link;Read more about sharing.
        Share this with Email Copy link;This video can not be played;Video unavailable in your region
        To play this video you need to enable JavaScript in your browser.;Listen to this article, {d} min
        Your device may not support playback of this clip;Enjoying this story? Subscribe for unlimited access
        Related: ‘{a} {n}’ ignored {N};More on this: {N} {n} vote after {a} {n} / Five things about the {N} {n}
        Read more: {N} {n} plan after {a} {n};Also read {N} {n} row after {a} {n};Read more: Why the {n} of {N} matters to every {n}
        Do you have a question about this story? Text or email us.;Join the conversation: {d} comments
        Sign up here for the Northbeacon weekly letter.;Sign up to the {N} briefing, sent every weekday morning
        Register for our newsletter and never miss an update;Follow Northbeacon on every platform;Follow us for more from {N}
        Get breaking news alerts on your phone: download our app;Was this page useful? Yes No
        Get in touch: send your story ideas to newsroom@nbeacon.example""",
    "opener": """Most read;Read more:;More on this story;More on this:;Also read;Related topics;Related:;Elsewhere on Northbeacon
        From other local news sites;In this story;Top stories;Promoted by our partners;Sponsored content;Features
        You may also like""",
    "link": """Why the {n} of {N} matters to every {n};Watch: {a} {n} near {N};Five things about the {N} {n};‘{a} {n}’ found {N}
        {N} {n} row after {a} {n};{N} {n} plan after {a} {n};{N} {n} warning after {a} {n};{N} {n} vote after {a} {n}
        {N} {n} appeal after {a} {n};{N} {n} delay after {a} {n};‘{a} {n}’ reported {N}""",
    "foot": """© {d} Northbeacon;Copyright © {d} Northbeacon. All rights reserved.;External links open in a new window.
        Northbeacon is not responsible for the content of external sites.;Read about our approach to external linking.
        Northbeacon {d}. No part may be reproduced without permission.;Back to top;Do not share or sell my info
        Terms of Use | About us | Privacy Policy | Cookies | Accessibility Help | Contact;Terms  Privacy  Cookies  Help
        Contact us;Work for us;Advertise with us;Privacy notice
        © {d} Northbeacon Read about our approach to external linking. Back to top""",
}

ENCYCLOPEDIA = {
    "en": {
        "top": """From Openlore, the shared encyclopaedia;Jump to navigation Jump to search;(Redirected from {N} {n})
            Article Talk Read Edit View history;Add languages
            Coordinates: {d}°{d}′N {d}°{d}′E
            This article needs more sources. Please help improve it. (March {d}) (Learn how and when to remove this message)""",
        "hatnote": "For the {n} of the same name, see {N} (disambiguation).",
        "tools": "Tools;What links here;Related changes;Upload file;Cite this page",
        "opener": "Contents",
        "heading": "History;Geography;Economy;Culture;Transport;Gallery;Notable people",
        "paragraph": NEWS["paragraph"],
        "item": NEWS["item"],
        "foot": """Categories: {N} | {n} | {d} establishments;Hidden categories: Pages with missing dates, All stubs
            This page was last edited on {d} March {d}, at {d}:{d}.;Retrieved from https://openlore.example/index?oldid={d}
            Text is available under an open licence; additional terms may apply.
            This {n}-related article is a stub. You can help by expanding it.;v t e {N} {n}""",
        "legal": "Privacy policy;About Openlore;Disclaimers;Mobile view",
    },
    "de": {
        "top": """aus Openlore, der gemeinsamen Enzyklopädie;Zur Navigation springen Zur Suche springen;Weiterleitung von {N}
            Artikel Diskussion Lesen Bearbeiten Versionsgeschichte;Koordinaten: {d}° {d}′ N, {d}° {d}′ O
            Dieser Artikel ist nicht hinreichend mit Belegen ausgestattet.;Dieser Artikel behandelt {N}; siehe auch {N}.""",
        "tools": "Werkzeuge;Links auf diese Seite;Druckversion;Seite zitieren",
        "opener": "Inhaltsverzeichnis",
        "heading": "Geschichte;Lage;Wirtschaft;Kultur;Verkehr;Persönlichkeiten",
        "paragraph": """Die Mühle von {N} stand neben dem Fluss, und der Bäcker kaufte das Haus im Jahr {d}.
            Der Turm von {N} wurde nach dem Sturm gebaut, obwohl die Gemeinde kein Geld hatte. Später kam der Lehrer aus {N}.""",
        "foot": """Kategorien: {N} | Gegründet {d};Diese Seite wurde zuletzt am {d}. März {d} um {d}:{d} Uhr bearbeitet.
            Der Text ist unter einer offenen Lizenz verfügbar.;Abgerufen von https://openlore.example/index?oldid={d}
            Dieser Artikel ist ein Stub. Hilf mit, ihn zu erweitern.""",
        "legal": "Datenschutz;Über uns;Impressum",
    },
    "fr": {
        "top": """De Openlore, l'encyclopédie partagée;Aller à la navigation Aller à la recherche;Redirigé depuis {N}
            Article Discussion Lire Modifier Voir l'historique;Cet article ne cite pas suffisamment ses sources ({d}).
            Coordonnées : {d}° {d}′ N, {d}° {d}′ E;Pour les articles homonymes, voir {N}.""",
        "tools": "Outils;Pages liées;Version imprimable;Citer cette page",
        "opener": "Sommaire",
        "heading": "Histoire;Géographie;Économie;Culture;Transports",
        "paragraph": """Le moulin de {N} se trouvait près de la rivière, et le boulanger a acheté la maison en {d}.
            La tour de {N} a été construite après la tempête, bien que la commune n'ait pas d'argent. Plus tard, {N} est venu.""",
        "foot": """Catégories : {N} | Fondation en {d};Cet article est une ébauche. Vous pouvez l'améliorer.
            La dernière modification de cette page a été faite le {d} mai {d} à {d}:{d}.
            Cet article concernant {N} est une ébauche.;Ce document provient de https://openlore.example/index?oldid={d}""",
        "legal": "Politique de confidentialité;À propos;Avertissements",
    },
    "es": {
        "top": """De Openlore, la enciclopedia compartida;Ir a la navegación Ir a la búsqueda;Redirigido desde {N}
            Artículo Discusión Leer Editar Ver historial;Este artículo necesita más fuentes fiables ({d}).
            Coordenadas: {d}° {d}′ N {d}° {d}′ E;Para otros usos, véase {N} (desambiguación).""",
        "tools": "Herramientas;Lo que enlaza aquí;Versión para imprimir;Citar esta página",
        "opener": "Índice",
        "heading": "Historia;Geografía;Economía;Cultura;Transporte",
        "paragraph": """El molino de {N} estaba cerca del río, y el panadero compró la casa en {d}.
            La torre de {N} fue construida después de la tormenta, aunque el pueblo no tenía dinero. Más tarde llegó {N}.""",
        "foot": """Categorías: {N} | Fundaciones de {d};Esta página se editó por última vez el {d} may {d} a las {d}:{d}.
            Este artículo sobre {N} es un esbozo. Puedes ayudar a ampliarlo.
            Obtenido de https://openlore.example/index?oldid={d}""",
        "legal": "Política de privacidad;Acerca de;Limitación de responsabilidad",
    },
    "zh": {
        "top": """Openlore，共享的百科;跳转到导航 跳转到搜索;条目 讨论 阅读 编辑 查看历史;此条目需要补充更多来源（{d}年）
            重定向自{N};坐标：{d}°{d}′N {d}°{d}′E""",
        "tools": "工具;链入页面;打印版本;引用此页",
        "opener": "目录",
        "heading": "历史;地理;经济;文化;交通",
        "paragraph": """磨坊在河流附近，面包师在{d}年买了房子，但是城堡也关闭了。风暴以后，村庄建立了塔楼。
            虽然学校没有钱，委员会也找到了地图，所以公司批准了北部的运河，共有{d}人。""",
        "foot": "分类：{d}年建立;本页面最后修订于{d}年{d}月{d}日 {d}:{d}。;这是一篇小作品。你可以扩充它。",
        "legal": "隐私政策;关于我们;免责声明",
    },
    "ja": {
        "top": """Openlore、みんなの百科事典;ナビゲーションに移動 検索に移動;ページ ノート 閲覧 編集 履歴表示
            この記事は出典がまったく示されていません（{d}年）;座標: 北緯{d}度{d}分 東経{d}度{d}分""",
        "tools": "ツール;リンク元;印刷用バージョン;このページを引用",
        "opener": "目次",
        "heading": "歴史;地理;経済;文化;交通",
        "paragraph": """水車小屋は川の近くにあった。パン屋は古い家を買った。しかし、学校は嵐の後ろで閉鎖した。
            村は教師によって塔を開いた。だから、静かな海岸は地元の会社を支えた。""",
        "foot": "カテゴリ: {d}年設立;最終更新 {d}年{d}月{d}日 {d}:{d};この項目は書きかけの項目です。",
        "legal": "プライバシー・ポリシー;免責事項",
    },
    "ar": {
        "top": """من Openlore، الموسوعة المشتركة;اذهب إلى التنقل اذهب إلى البحث;مقالة نقاش اقرأ عدل تاريخ
            هذه المقالة بحاجة إلى مصادر ({d}).;إحداثيات: {d}°{d}′ شمال {d}°{d}′ شرق""",
        "tools": "أدوات;ماذا يصل هنا;نسخة للطباعة",
        "opener": "المحتويات",
        "heading": "التاريخ;الجغرافيا;الاقتصاد;الثقافة",
        "paragraph": """المطحنة قرب النهر، الخباز باع المنزل بعد سنوات قليلة. البرج في القرية بعد العاصفة.
            القبطان زار السوق في الشتاء، رغم أن المدرسة نقلت الأرشيف قرب الجسر.""",
        "foot": "تصنيفات: تأسيسات {d};آخر تعديل لهذه الصفحة كان يوم {d} مايو {d}.;هذه بذرة مقالة عن {N}.",
        "legal": "سياسة الخصوصية;حول الموقع;إخلاء مسؤولية",
    },
}


#: More lines, of the kinds that sites at large have, in the wording of no table the tests read.
MORE_NEWS = {
    "sections": """Top Headlines;Opinion;Editorials;Markets;Lifestyle;Food;Style;Real Estate;Obituaries;Podcasts;Newsletters;Crosswords
        Nachrichten;Wirtschaft;Feuilleton;Sport heute;Wissen;Actualités;Économie;Culture et loisirs;Deportes;Economía;Opinión;Cronaca;Esteri
        Photos;Long reads;Fact check;Technology;Climate;Environment;Entertainment;Elections;US & Canada;Europe;Asia;Africa;Middle East""",
    "top": """Skip navigation;Go to content;Open menu;Close menu;Toggle navigation;Search this site;Search for:;Log in;Log out;Create account;Subscribe
        Subscribe now;My profile;Switch to dark mode;Choose your edition;US edition;Back to home page;Print subscriptions;Support us;Become a member
        Zum Inhalt springen;Anmelden;Jetzt abonnieren;Aller au contenu principal;Se connecter;S'abonner;Ir al contenido;Iniciar sesión;Suscríbete
        Vai al contenuto;Accedi;Abbonati;Inloggen;Naar de inhoud;Entrar;Ir para o conteúdo;Log in or sign up to read on;E-paper;Jobs;Dating;Shop""",
    "notice": """This website uses cookies to improve your experience. By using our site you accept our cookie policy.
        We value your privacy. We store and access information on a device, such as unique identifiers, to process personal data.
        You can change your preferences at any time in the privacy centre.;Accept cookies;Decline;Only necessary cookies;Customise;Save preferences
        Wir verwenden Cookies, um Inhalte und Anzeigen zu personalisieren. Mehr erfahren;Alle akzeptieren;Einstellungen;Ablehnen
        Nous utilisons des cookies pour mesurer l'audience et vous proposer des contenus adaptés.;Tout accepter;Continuer sans accepter
        Usamos cookies propias y de terceros para mejorar nuestros servicios.;Aceptar todo;Rechazar;Questo sito utilizza cookie tecnici e di profilazione.
        You have reached your limit of free articles this month. Subscribe to continue.;Already a subscriber? Log in;Please disable your ad blocker""",
    "inline": """Share on Facebook;Share on X;Share via email;Tweet;Pin it;Print this page;Save for later;Add to bookmarks;Copy URL;Comments ({d});Leave a comment
        Read full article;Continue reading below;Story continues below advertisement;Skip advertisement;Sponsored;Paid post;Ad;Click here to watch
        Click to enlarge;Play video;Watch live;Listen ({d} min);Get our daily newsletter straight to your inbox;Enter your email address;Sign up for free
        You can unsubscribe at any time.;Download the {N} app for iOS and Android;Follow {N} on social media;Have a tip? Contact our reporters
        Teilen;Drucken;Kommentare ({d});Anzeige;Partager;Publicité;Lire aussi : le {n} de {N};Compartir;Publicidad;Condividi;Pubblicità;Lees ook: {N}
        Rate this article;Report a mistake;Translate this page;Updated {d} minutes ago;{d} min read;By {N} {N}, staff reporter | {d} comments""",
    "opener": """Recommended for you;Trending now;Latest news;Editor's picks;Don't miss;Popular now;More from {N};Related articles;See also our coverage
        Around the web;Mehr zum Thema;Meistgelesen;À lire aussi;Les plus lus;Lo más leído;Te puede interesar;Leggi anche;Meest gelezen;Stay in touch""",
    "link": """How {N} became a {n} of the {n};What we know about the {a} {n};{N} {n} explained;In photos: the {a} {n};Opinion | The {n} that {N} forgot
        {N} says {n} will not return;The {d} best {n}s this year;{N} vs {N}: live updates;Video: {n} falls on {a} {n}""",
    "foot": """© {N} Media Group {d};© {d} {N} Ltd. Registered in England no. {d};All rights reserved;Terms and conditions;Privacy settings;Cookie policy
        Legal notice | Data protection | Imprint;Impressum | Datenschutz | AGB;Mentions légales | Confidentialité;Aviso legal | Privacidad;Sitemap;RSS
        Accessibility statement;Complaints and corrections;Modern slavery statement;Careers;Press office;Subscribe | Help | Feedback;Powered by {N}
        This site is protected by reCAPTCHA and the privacy policy and terms of service apply.;Do Not Sell My Personal Information;Ad choices
        The content of external websites is not our responsibility.;Scroll to top;Follow us: Facebook Twitter Instagram YouTube""",
}
MORE_ENCYCLOPEDIA = {
    "en": {
        "top": """From {N}, the free encyclopedia;Main page Contents Current events Random article;Read View source View history
            This article includes a list of references but its sources remain unclear. (May {d});This section does not cite any sources.
            Part of a series on {n};Page information;Download as PDF;Printable version;Languages;{d} languages""",
        "tools": "Permanent link;Page information;Special pages;Get shortened URL;Wikidata item;Print/export",
        "heading": "Early life;Career;Legacy;Etymology;Climate;Demographics;Education;Reception;Death;Background;Production",
        "foot": """Categories: {d} births | Living people | People from {N};Authority control;Portal: {N};This article about a {n} is a stub.
            Content is available under a share-alike licence unless otherwise noted.;Contact {N};Code of Conduct;Developers;Statistics""",
    },
    "de": {
        "top": "Seite Diskussion Quelltext anzeigen Versionsgeschichte;Hauptseite Themenportale Zufälliger Artikel;In anderen Projekten;Begriffsklärung",
        "heading": "Leben;Werk;Literatur;Name;Klima;Bevölkerung;Politik;Bauwerke",
        "foot": "Kategorien: Mann | Geboren {d} | Ort in {N};Normdaten;Nutzungsbedingungen;Entwickler;Stellungnahme zu Cookies;Mobile Ansicht",
    },
    "fr": {
        "top": "Page Discussion Modifier le code;Accueil Portails thématiques Article au hasard;Dans d'autres langues;Cet article est une section à compléter.",
        "heading": "Biographie;Œuvres;Toponymie;Climat;Démographie;Notes",
        "foot": "Catégories : Naissance en {d} | Commune de {N};Portail de {N};Conditions d'utilisation;Développeurs;Statistiques",
    },
    "es": {
        "top": "Página Discusión Ver código;Portada Actualidad Página aleatoria;En otros idiomas;Este artículo es huérfano.",
        "heading": "Biografía;Obra;Toponimia;Clima;Demografía;Premios",
        "foot": "Categorías: Nacidos en {d} | Localidades de {N};Control de autoridades;Términos de uso;Desarrolladores;Estadísticas",
    },
}


def _joined(table: dict[str, str], more: dict[str, str]) -> dict[str, str]:
    return {part: "\n".join(filter(None, (table.get(part), more.get(part)))) for part in {**table, **more}}


NEWS = _joined(NEWS, MORE_NEWS)
ENCYCLOPEDIA = {code: _joined(table, MORE_ENCYCLOPEDIA.get(code, {})) for code, table in ENCYCLOPEDIA.items()}
#: Lines left out of the pages; for measuring what the table is worth on lines it does not have.
LEFT_OUT: set[str] = set()


def lines(table: dict[str, str], part: str) -> list[str]:
    """Return the lines of a part; a row of sentences is one line, a row with ``;`` several."""
    out: list[str] = []
    for row in table.get(part, "").split("\n"):
        row = row.strip()
        if "licence;" in row or "{N}; " in row:
            row = row.replace("licence;", "licence\0").replace("{N}; ", "{N}\0 ")
        out += [x.replace("\0", ";") for x in row.split(";") if x]
    return [x for x in out if x not in LEFT_OUT] or out


class Maker:
    """Puts training pages together; the same seed gives the same pages.

    With ``foreign``, most sentences of the article are in words that no labelled line has.
    """

    def __init__(self, seed: int = 7, foreign: bool = False) -> None:
        self.r, self.foreign = random.Random(seed), foreign
        self.words = [self._word() for _ in range(400)]

    def _word(self) -> str:
        return "".join(self.r.choice("bcdfghjklmnprstvwz") + self.r.choice("aeiou") for _ in range(self.r.randint(2, 4)))

    def _fill(self, line: str) -> str:
        while "{" in line:
            at = line.index("{")
            kind = line[at + 1]
            word = {"N": self._word().title(), "d": str(self.r.randint(1, 2030))}.get(kind) or self.r.choice(self.words)
            if kind == "a" and (at == 0 or line[at - 1] in "‘:"):
                word = word.title()
            line = line[:at] + word + line[at + 3 :]
        return line

    def _some(self, table: dict[str, str], part: str, low: int, high: int) -> list[tuple[str, str]]:
        own = lines(table, part)
        picked = self.r.sample(own, min(len(own), self.r.randint(low, high)))
        return [(part, self._fill(x)) for x in picked]

    def _listed(self, labels: list[str], part: str) -> list[tuple[str, str]]:
        """Return labels on a line each or, joined by a separator, on one."""
        joint = self.r.choice(["\n", " | ", " · ", " • ", "\t", "  ", " / ", " > ", " ", ", "])
        if joint == "\n":
            return [(part, x) for x in labels]
        return [(part, joint.join(labels))]

    def _spoilt(self, line: str) -> str:
        """Change a line a little, as copies do."""
        words = line.split(" ")
        at = self.r.randrange(len(words))
        words[at : at + self.r.randint(0, 1)] = [self._word()]
        return " ".join(words).upper() if self.r.random() < 0.3 else " ".join(words)

    def _foreign(self, line: str) -> str:
        """Replace most words, or Chinese and Japanese characters, of a sentence by invented ones."""
        if re.search(r"[一-鿿]", line):
            return "".join(chr(self.r.randint(0x4E00, 0x9FA5)) if "一" <= c <= "鿿" else c for c in line)
        words = re.split(r"(\w+)", line)
        said = re.findall(r"[a-z]{3,}", f"{NEWS['inline']} {NEWS['link']} {NEWS['notice']}".lower())
        for i, w in enumerate(words):
            if w.isalpha() and (chance := self.r.random()) < 0.9:
                words[i] = self._word() if chance < 0.8 else self.r.choice(said)
        return "".join(words)

    def _body(self, table: dict[str, str], inline: bool) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        for _ in range(self.r.randint(2, 8)):
            text = " ".join(x for _, x in self._some(table, "paragraph", 1, 2))
            text = self._foreign(text) if self.foreign and self.r.random() < 0.6 else text
            out.append(("paragraph", text))
            if self.r.random() < 0.3:
                out += self._some(table, "heading", 1, 1)
            if self.r.random() < 0.12:
                out += self._some(table, "item", 1, 1)
            if inline and self.r.random() < 0.25:
                if self.r.random() < 0.25:
                    joint = " / ".join(x for _, x in self._links(table))
                    out.append(("inline", f"{self._some(table, 'opener', 1, 1)[0][1].rstrip(':')}: {joint}"))
                else:
                    out += self._some(table, "inline", 1, 1)
                if self.r.random() < 0.2:
                    out += self._some(table, "heading", 1, 1)
            if inline and self.r.random() < 0.08:
                out += self._some(table, "opener", 1, 1) + self._links(table)
                if self.r.random() < 0.4:
                    out += self._some(table, "heading", 1, 1)
        return out

    def _links(self, table: dict[str, str]) -> list[tuple[str, str]]:
        out = []
        for i in range(self.r.randint(1, 5)):
            line = self._fill(self.r.choice(lines(table, "link")))
            line = f"{i + 1} {line}" if self.r.random() < 0.3 else line
            out.append(("link", f"{line} {self.r.randint(2, 23)} hrs ago" if self.r.random() < 0.2 else line))
        return out

    def news(self) -> list[tuple[str, str]]:
        """Return a news page as (part, line) rows."""
        r, out = self.r, []
        if r.random() < 0.6:
            out += self._some(NEWS, "top", 0, 3)
            labels = r.sample(lines(NEWS, "sections"), r.randint(3, 10))
            out += [("top", "Menu" + "".join(labels))] if r.random() < 0.2 else self._listed(labels, "top")
            out += self._some(NEWS, "notice", 0, 3)
        out += self._body(NEWS, True)
        for _ in range(r.randint(0, 2)):
            if r.random() < 0.6:
                out += self._some(NEWS, "opener", 1, 1) + self._links(NEWS)
            else:
                labels = [self._word().title() for _ in range(2)] + r.sample(lines(NEWS, "sections"), 2)
                out += [("opener", r.choice(["Tags:", "Topics", "Related topics"]))] + self._listed(labels, "link")
        if r.random() < 0.6:
            out += self._some(NEWS, "inline", 0, 2) + self._some(NEWS, "foot", 1, 4)
        return out

    def encyclopedia(self, code: str) -> list[tuple[str, str]]:
        """Return an encyclopedia page in a language as (part, line) rows."""
        r, table, out = self.r, ENCYCLOPEDIA[code], []
        if r.random() < 0.7:
            out += self._some(table, "top", 0, 5)
            out += self._some(table, "hatnote", 0, 1)
            if r.random() < 0.4:
                out += self._listed(lines(table, "tools"), "top")
            if r.random() < 0.5:
                heads = r.sample(lines(table, "heading"), r.randint(2, len(lines(table, "heading"))))
                heads = [f"{i + 1} {h}" for i, h in enumerate(heads)] if r.random() < 0.5 else heads
                first = self._fill(lines(table, "opener")[0])
                if r.random() < 0.3:
                    out.append(("opener", " ".join([first, *heads])))
                else:
                    out += [("opener", first)] + [("link", h) for h in heads]
        out += self._body(table, False)
        if r.random() < 0.8:
            out += self._some(table, "foot", 1, 4)
            if r.random() < 0.5:
                out += self._listed(lines(table, "legal"), "foot")
            if r.random() < 0.5:
                names = self._listed([self._word().title() for _ in range(r.randint(5, 14))], "foot")
                at = len(out) - r.randint(0, 4)
                out[at:at] = names if len(names) == 1 else []
        return out

    def pages(self, n: int) -> list[list[tuple[str, str]]]:
        """Return ``n`` pages as (label, line) rows; labels are ``+``, ``-`` and ``=`` for openers."""
        out = []
        codes = ["en", *ENCYCLOPEDIA]
        for i in range(n):
            page = self.news() if i % 2 else self.encyclopedia(codes[i // 2 % len(codes)])
            spoilt = [
                (p, self._spoilt(x) if p != "paragraph" and self.r.random() < 0.06 else x.upper() if self.r.random() < 0.03 else x)
                for p, x in page
            ]
            out.append([("+" if p in ARTICLE else "=" if p == "opener" else "-", x) for p, x in spoilt])
        return out
