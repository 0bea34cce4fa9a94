"""Held-out texts for the residue operator, written by hand and not read off any table.

REAL holds prose that only speaks of errors, templates, scripts or missing things, in several
languages, beside plain content; FALSE holds what publishing and web systems put in place of content.
"""

REAL = """
The edition is displayed in a JavaScript viewer written by the museum.
Captcha systems were trained on scanned books.
Wartungsarbeiten am Tempel sind in KUB 12 beschrieben.
In the museum the archive is under maintenance of the king's scribes.
Please try again later, said the king to the envoy.
The scribe made an error in line 404 and corrected it on the edge.
Access to the inner court was denied to everyone but the priests.
The tablet was not found in the excavation of 1907.
A page of the codex is missing between folio 12 and folio 13.
The word template derives from the weaver's templet.
She argued that the error was introduced by a careless copyist.
The service of the temple was unavailable to strangers.
Cookies were baked from emmer flour, honey and sesame.
His cookies and bread are listed among the rations for the month.
The script of the inscription is early and its signs are deeply cut.
The scripts of Anatolia were studied by three generations of scholars.
In quality assurance, the phrase "page not found" is tested on every release.
The phrase “something went wrong” appears in the novel eleven times.
"Access denied", said the guard at the gate of the citadel.
The envoy replied: "You do not have permission to enter", and left the city.
Lorem ipsum is a filler text derived from Cicero's treatise on ends.
The term "lorem ipsum" was first used by typesetters in the sixteenth century.
The number 500 stands on the reverse, followed by a broken sign.
Fragment 403 joins the upper edge of fragment 404.
Of 503 tablets, 404 were found in room 12.
The server carried the wine to the table of the queen.
Servers of the king's table received two measures of barley.
The internal walls were in error drawn as external ones.
An internal error in the count of the days explains the difference.
The catalogue lists 1,204 entries and two concordances.
The record of the trial was removed to the archive in 1912.
This page of the manuscript shows a later hand.
This document was moved from the palace to the temple in the reign of the second king.
The link between the two myths has been discussed since Frazer.
The site was abandoned after the fire and later used as a quarry.
The gate was closed for maintenance of the hinges, as the letter says.
Maintenance of the canals was the duty of the governor.
The session of the council ended before the evening.
His session with the diviners was timed by the water clock.
The connection was lost when the bridge over the river fell.
The connection between the two houses was refused by the elders.
He requested the tablet, but it could not be found by the librarian of the palace.
The requested grain was not delivered to the garrison.
The term exception is used by grammarians for irregular verbs.
An exception to the rule is the verb to be.
The stack of tablets had traces of fire on one side.
Python snakes are not attested in this region.
Java was reached by traders only much later.
The null hypothesis is that both hands belong to one scribe.
The value is undefined for fragments without a findspot.
The index of the volume is out of date.
The key was lost and the chest had to be broken open.
The attribute of the goddess is a lion.
Insert the new leaf after page 12 of the printed volume.
The blank spaces were to be filled by a second scribe who never came.
The name was left open in the template and filled in after the sale.
Your gods and my gods shall be witnesses, writes the king.
Your messenger has reached me and your words I have heard.
Enter the temple at dawn and pour a libation before the statue.
Type the name of the month and the day at the end, as was the custom of the clerks.
The example shows how the scribe replaced one sign with another.
Replace the lid of the jar after the oil has been poured.
The sample was taken from the core of the brick.
Sample 14 contained traces of copper and tin.
This is a sample taken from the third layer of the mound.
The test of the oracle was repeated three times.
The test entry in the diary of the excavator is dated to 3 May.
The dummy tablets in the school were made of unbaked clay.
The note on the margin says that the work is to be completed by his son.
The chapter remains to be completed.
The king is to be announced by the herald at the gate.
The reading is to be confirmed by collation.
The place here described is a pass in the mountains.
The quick fox and the lazy lion appear in a fable.
The dolor of exile is a frequent theme of the laments.
The letter begins: say to my lord, thus speaks your servant.
He was forbidden to enter and went away.
It is forbidden to cut the trees of the sacred grove.
The payment was required before the harvest.
Payment required of each household was one shekel.
The bad request of the vassal was refused.
The bad gateway of the fort was rebuilt in stone.
The method was not allowed by the guild of the builders.
The conflict between the brothers lasted for seven years.
The goods are gone and the merchant is dead, the letter reports.
The length required for the beam was twelve cubits.
The text in braces {d}UTU and {KUR}Ḫatti shows determinatives.
The lacuna [x x x x] can be restored from the duplicate.
[lugal kur] ḫat-ti ⸢dumu⸣ x x x
<NUM> udu <NUM> gu₄ x x [x x x x]
1′ nu-za ma-a-an [x x x] ḫa-an-te-ez-zi-ya-az
{giš}banšur-aš pé-ra-an kat-ta da-a-i
The set {a, b, c} has three elements and {x, y} two.
The interval [0, 1] is closed, the interval (0, 1) is open.
Prices ranged from $12 to $30 for a facsimile.
The discount was 40% for members and 20% for students.
In the formula f(x) = {x : x > 0} the braces denote a set.
KUB XXX: 15 is joined with KBo XXX: 3.
See also note 12 [with further literature].
The list [of witnesses] is broken.
He wrote [in Akkadian] to the king of Egypt.
The seal reads «servant of the storm god».
The title «Great Family» is known from a single seal.
In this tutorial for example `{{ name }}` is replaced by the value of the variable when the page is rendered.
The documentation explains the syntax: for example `${site}` is replaced by the name of the excavation site.
Der Fehler des Schreibers wurde in Zeile 12 verbessert.
Die Seite der Handschrift wurde nicht gefunden, weil sie im Krieg verloren ging.
Die Tafel ist derzeit nicht zugänglich, weil das Museum umgebaut wird.
Der Zugang zum Tempel wurde den Fremden verweigert.
Der Schreiber ließ den Platz für den Namen frei.
Die Skripte der Vorlesung sind im Lesesaal ausgelegt.
Die Vorlage wurde von drei Schülern abgeschrieben.
Sie müssen die Opfer am dritten Tag darbringen, sagt der Text.
Der Dienst im Tempel begann am Morgen.
Das Wort „Zugriff verweigert“ findet sich in keinem Wörterbuch der Zeit.
Hier steht ein Bild der Göttin auf einem Löwen.
Die Abschrift enthält einen Fehler, der schon in der Vorlage stand.
Im Archiv wurden 404 Tafeln gefunden.
Bitte und Dank stehen am Anfang des Briefes.
Une erreur du scribe explique la forme de la ligne 3.
La page du manuscrit est perdue depuis 1870.
L'accès au sanctuaire était refusé aux étrangers.
Le service du temple était assuré par douze prêtres.
La tablette demandée par le roi fut envoyée en hiver.
Le texte de la lettre est complet, sauf la dernière ligne.
Le mot « erreur » n'apparaît pas dans la lettre.
Il réessaya plus tard de prendre la ville, mais sans succès.
L'errore dello scriba si trova nella riga 12.
La pagina del codice è stata strappata.
L'accesso al tempio era negato agli stranieri.
Il servizio del tempio era affidato a dodici sacerdoti.
Il re provò più tardi ad assediare la città.
El error del escriba aparece en la línea 7.
La página del códice se perdió en el incendio.
El acceso al templo estaba prohibido a los extranjeros.
El servicio del templo comenzaba al amanecer.
O erro do escriba foi corrigido na margem.
A página do códice foi encontrada em 1932.
Kâtibin hatası on ikinci satırda düzeltilmiştir.
Tabletin kayıp parçası müzede bulunmuştur.
De fout van de schrijver staat in regel 12.
De pagina van het handschrift is verloren gegaan.
Błąd pisarza znajduje się w wierszu 12.
Strona rękopisu zaginęła podczas wojny.
Ошибка писца исправлена на полях.
Страница рукописи была утрачена в 1812 году.
Skrivarens fel rättades i marginalen.
Sidan ur handskriften har gått förlorad.
Chyba písaře je opravena na okraji.
Stránka rukopisu se ztratila za války.
Fejlen i afskriften blev rettet af en anden hånd.
Virhe on korjattu reunaan toisella kädellä.
Az írnok hibáját a margón javították.
Το σφάλμα του γραφέα διορθώθηκε στο περιθώριο.
書記の誤りは十二行目で訂正されている。
粘土板の一部は発見されていない。
博物館では粘土板のメンテナンスについて講演があった。
抄写员的错误在第十二行得到了更正。
这块泥板的下半部分尚未找到。
这一页手稿在战争中遗失了。
서기의 실수는 열두째 줄에서 고쳐졌다.
이 점토판의 아랫부분은 아직 발견되지 않았다.
خطأ الكاتب مصحح في السطر الثاني عشر.
فقدت صفحة من المخطوط أثناء الحرب.
הטעות של הסופר תוקנה בשוליים.
Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae.
Arma virumque cano, Troiae qui primus ab oris Italiam fato profugus venit.
In principio erat verbum et verbum erat apud deum.
Quousque tandem abutere, Catilina, patientia nostra?
Catalogue entry 12.4: a small tablet, 45 × 62 × 20 mm, complete.
Findspot: temple I, room 12, in the debris above the floor.
Edited by a team of four scholars between 1998 and 2004.
Line 3 preserves the beginning of the name, line 4 is lost.
About 40 lines are missing at the beginning of the column.
The colophon is broken away and the scribe unknown.
The date is unknown, the place of writing is not stated.
The photograph is not available; the copy was made from a cast.
The content of the third column is discussed below.
The content of content words is higher in letters than in rituals.
He went on and on and on until the evening came.
ha ha the demon laughed and the river rose.
No, no, no, said the old woman, that is not my son.
The numbers 401, 402 and 403 were given to three joining pieces.
An HTTP server stores the images of the tablets, as the report of 2019 describes.
The database of the project holds 21,868 documents in five formats.
The database query language was taught in the second week of the school.
The browser of the collection lists all tablets by size.
The project required JavaScript developers and two philologists for four years.
Our web archive was built with JavaScript and a small database in 2015, which three students had to maintain.
In the chapter on error pages the author compares forty museum websites.
The lecture on missing pages in digital editions drew a large audience.
Error analysis of the readings shows that 12 of 40 differ.
The error rate was 4.5 per cent on the held-out tablets.
The warning of the oracle was not heeded by the king.
A fatal error of the general led to the loss of the army.
The fatal error in judgement was the march through the desert.
The access road was blocked by the fall of the tower.
The password of the guards was changed every night.
The login of the visitors is kept in a book at the desk.
They were down at the river when the messenger came.
The water was down and the ford could be crossed.
I will be back before the new moon, writes the merchant to his wife.
He said he would be back soon and took the road to the south.
The curse formula reads: whoever removes this tablet, may the gods remove his name.
The omen reads “if a page is torn, the house will fall”.
The heading “To do” in the notebook of the excavator precedes a list of soundings.
The field notes were typed by the secretary in 1934.
The fields {of the temple} are mentioned in the annals.
The percentage %wt of tin was measured in twelve samples.
A placeholder sign marks the empty column in the multiplication table.
Zero was written with a placeholder of two slanted wedges.
The copy has two wedges where the original has three; the edition follows the original.
The following words are not in the dictionary and need further study.
The translation of the third paragraph follows the German one of 1964.
The museum was closed in 1939 and the tablets were packed into 120 crates.
""".strip().split("\n")

FALSE = """
Dear [Customer Name], your order has shipped.
Hello {{first_name}}, welcome to our collection.
Hi %FIRSTNAME%, thank you for your visit.
Dear ${user.name}, your request was received.
Catalogue entry: [Insert title here]
[Your Name], curator of the collection
Published by [Company Name] in [Insert year].
The tablet was found in <<location>> in the year <<year>>.
Edited by {editor_name:s} and {0}.
Title: __TITLE__
Author: @@AUTHOR@@
Museum number: ##MUSEUM_NO##
[[DESCRIPTION]]
{% block content %}{% endblock %}
<%= record.title %>
<?php echo $title; ?>
#{record.name} was found in #{record.place}.
{$site.name}
%(title)s, %(year)s
[Bitte Titel einfügen]
[Titel hier ergänzen]
[Insérer le titre]
[insertar nombre]
[inserire il titolo qui]
[enter description]
(To be completed)
[Image placeholder]
{placeholder text}
Your text goes here
Insert your description here.
Add a caption here
TODO: write the commentary
FIXME: wrong museum number
TBD: findspot
TODO add translation
[t.b.d.]
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.
Curabitur pretium tincidunt lacus, nulla gravida orci a odio nullam varius turpis et commodo pharetra.
Sample text sample text sample text sample text sample text
Blindtext Blindtext Blindtext Blindtext Blindtext
test test test test test test
asdf asdf asdf asdf asdf asdf
content content content content content content
The quick brown fox jumps over the lazy dog.
This is a sample page. Edit or delete it, then start writing!
This is dummy text.
This is placeholder content.
Click to edit this text.
Double-click to edit
Test post please ignore
Please ignore, delete me
Dies ist ein Beispieltext.
Hier steht ein Blindtext.
Klicken Sie hier, um den Text zu bearbeiten.
Ceci est un texte d'exemple.
Questo è un testo di esempio.
Este es un texto de ejemplo.
Bu bir örnek metin alanıdır.
404 Not Found
Error 404: page not found
HTTP 500 Internal Server Error
502 Bad Gateway
503 Service Unavailable
403 Forbidden
401 Unauthorized
504 Gateway Timeout
429 Too Many Requests
Error 410: Gone
nginx/1.18.0
Apache/2.4.41 (Ubuntu) Server at localhost Port 80
Whitelabel Error Page
Page not found.
The page you requested could not be found.
The page you are looking for has been moved.
This page does not exist.
This page is no longer available.
The requested URL /tablet/12 was not found on this server.
The requested resource could not be found.
Sorry, the page cannot be displayed.
Oops! Something went wrong.
Something went wrong. Please try again later.
An unexpected error occurred.
An error has occurred while loading the record.
An internal server error occurred.
Failed to load resource
Unable to load the image
Could not load the viewer
Service temporarily unavailable
The service is currently unavailable.
The server is temporarily overloaded.
The site is down for maintenance.
The website is currently undergoing maintenance.
Scheduled maintenance in progress.
We will be back shortly.
We'll be back soon!
Access denied.
Permission denied
You do not have permission to view this page.
You are not authorized to access this resource.
Please log in to view this record.
Your session has expired. Please log in again.
Session expired
Please try again later.
Please try again in a few minutes.
Retry after 60 seconds.
Rate limit exceeded
Please complete the captcha to continue.
Checking your browser before accessing the site.
Verify you are human.
Please prove that you are not a robot.
Unusual traffic from your network was detected.
Database connection failed
Error establishing a database connection
MySQL server error
SQLSTATE[HY000] [2002] Connection refused
ORA-00942: table or view does not exist
You have an error in your SQL syntax
Too many connections
Connection timed out
Connection refused
The upstream server did not respond.
Request timed out
Traceback (most recent call last):
  File "app.py", line 12, in <module>
ValueError: invalid literal for int()
KeyError: 'title'
java.lang.NullPointerException
    at org.example.Main.run(Main.java:12)
Exception in thread "main"
Uncaught TypeError: Cannot read property 'x' of undefined
undefined is not a function
Fatal error: Call to undefined function
Warning: mysql_connect()
Parse error: syntax error, unexpected end of file
Segmentation fault (core dumped)
panic: runtime error: index out of range
Unhandled exception
Go back to the home page
Return to homepage
Seite nicht gefunden
Die angeforderte Seite existiert nicht.
Die angeforderte Seite konnte nicht gefunden werden.
Es ist ein Fehler aufgetreten.
Ein unerwarteter Fehler ist aufgetreten.
Bitte versuchen Sie es später erneut.
Der Dienst ist derzeit nicht verfügbar.
Zugriff verweigert
Interner Serverfehler
Wegen Wartungsarbeiten ist die Seite derzeit nicht erreichbar.
Sie haben keine Berechtigung, diese Seite anzuzeigen.
Page introuvable
La page demandée n'existe pas.
Une erreur est survenue.
Une erreur s'est produite. Veuillez réessayer plus tard.
Service temporairement indisponible
Accès refusé
Erreur interne du serveur
Pagina non trovata
La pagina richiesta non esiste.
Si è verificato un errore.
Errore del server
Servizio temporaneamente non disponibile
Accesso negato
Página no encontrada
Ha ocurrido un error.
Se ha producido un error inesperado.
Error interno del servidor
Servicio no disponible
Acceso denegado
Página não encontrada
Ocorreu um erro. Tente novamente.
Acesso negado
Sayfa bulunamadı
Bir hata oluştu. Lütfen daha sonra tekrar deneyin.
Erişim reddedildi
Pagina niet gevonden
Er is een fout opgetreden.
Nie znaleziono strony
Wystąpił błąd. Spróbuj ponownie.
Страница не найдена
Произошла ошибка. Попробуйте позже.
Доступ запрещён
Sidan kunde inte hittas
Ett fel har inträffat. Försök igen senare.
Åtkomst nekad
Siden blev ikke fundet
Det har oppstått en feil.
Sivua ei löytynyt
Stránka nebyla nalezena
Došlo k chybě. Zkuste to znovu.
Přístup odepřen
Az oldal nem található
Η σελίδα δεν βρέθηκε
Παρουσιάστηκε σφάλμα
ページが見つかりません
エラーが発生しました。しばらくしてからもう一度お試しください。
ただいまメンテナンス中です。
アクセスが拒否されました
页面不存在
页面未找到
发生错误，请稍后再试
系统维护中
找不到頁面
페이지를 찾을 수 없습니다
오류가 발생했습니다. 나중에 다시 시도하십시오.
الصفحة غير موجودة
حدث خطأ. يرجى المحاولة مرة أخرى.
تم رفض الوصول
הדף לא נמצא
Please enable JavaScript to view this page.
You need to enable JavaScript to run this app.
JavaScript is required.
JavaScript is disabled in your browser.
This site requires JavaScript.
<noscript>JavaScript must be enabled</noscript>
Please turn on cookies in your browser.
Cookies are required to use this site.
This website uses cookies.
Your browser does not support this feature.
Bitte aktivieren Sie JavaScript.
Diese Seite verwendet Cookies.
JavaScript ist deaktiviert.
Veuillez activer JavaScript.
JavaScript est nécessaire pour afficher cette page.
Abilita JavaScript per continuare.
Habilite JavaScript para continuar.
Ative o JavaScript para continuar.
Lütfen JavaScript'i etkinleştirin.
Schakel JavaScript in.
Włącz JavaScript.
Включите JavaScript.
Aktivera JavaScript för att visa sidan.
Povolte JavaScript.
JavaScriptを有効にしてください。
请启用JavaScript
JavaScript를 활성화하세요
يرجى تفعيل JavaScript
""".strip().split("\n")
