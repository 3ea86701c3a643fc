"""Seed texts for the models of :mod:`residue`: what servers, templates and script
loaders commonly leave, and sentences that only speak of such things.

``~`` stands for a name; fitting fills it with rare words of the corpus, so that the
models learn the wording and not the names.
"""

# The words of the traditional Latin filler passage.
LATIN_FILLER = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure "
    "dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat non "
    "proident sunt in culpa qui officia deserunt mollit anim id est laborum"
).split()

# Words typed to fill a space.
KEYBOARD_FILLER = "foo bar baz qux quux asdf asdfasdf qwer qwerty jkl hjkl zxcv xyz xxx abc test testing tbd tba bla blah blabla dummy sample lipsum todo fixme".split()

FILLER = """
This is sample text for the ~ block.
This is placeholder text for ~.
Your ~ goes here.
Your text here. Your content goes here.
Add your ~ here.
Replace this paragraph with your own ~.
Replace this text with your own words about ~.
Type something about ~, then delete this note.
Write a short description of ~ here.
Use this space to tell people about ~.
Use this area to describe your ~.
Dummy copy for ~, not final.
Dummy text, to be replaced before launch.
Sample content. Delete this block when you are done.
Click to edit this text and tell visitors about ~.
This is a text block. Double click to edit it.
Hello world! This is your first post. Edit or delete it, then start writing.
Placeholder copy for ~. Final text to follow.
Aquí va el texto sobre ~. Sustituya este párrafo por su propio texto.
Ici votre texte sur ~. Remplacez ce paragraphe par le vôtre.
Hier steht Ihr Text über ~. Ersetzen Sie diesen Absatz durch Ihren eigenen Text.
Texto de ejemplo para ~. Texte provisoire pour ~. Blindtext für ~.
""".strip().splitlines()

SCRIPTS = """
You need to enable JavaScript to run this app.
Please enable JavaScript to view this page.
Please enable JavaScript to continue using ~.
Please turn on JavaScript in your browser and reload the page.
Enable JavaScript and cookies to continue.
JavaScript is disabled in your browser, so we cannot show the ~.
JavaScript is required to view ~.
JavaScript must be enabled to use this site.
JavaScript seems to be disabled in your browser.
It looks like your browser has scripting turned off.
This site requires scripts. Turn them on and reload.
This page requires JavaScript. Your browser does not support it or has it switched off.
This page was built for browsers that execute scripts.
We're sorry but ~ doesn't work properly without JavaScript enabled. Please enable it to continue.
~ doesn't work without JavaScript enabled.
~ needs scripts. ~ needs JavaScript to start.
Turn on javascript, then reload ~.
To see ~, allow JS for this address.
JS must be on before ~ can load.
Scripts are blocked. Allow scripts for ~ and try again.
Content of ~ stays hidden until scripting is active.
Our reader for ~ works only with scripting switched on.
The ~ catalogue is drawn by your browser, which has scripting off.
Your browser blocks the code that shows ~.
Your browser does not run scripts, so nothing can be displayed.
Loading ~ ... if nothing happens, your browser does not run scripts.
Loading... Please wait.
Loading
Checking your browser before opening ~. This needs scripts and cookies.
Please wait while ~ is verified; scripts and cookies must be allowed.
Please wait while we verify that you are human. This process is automatic.
Cookies must be allowed too.
noscript: the ~ gallery cannot start here
noscript
The viewer for ~ could not start because scripting is unavailable.
Active JavaScript para ver ~ en su navegador.
~ requiere JavaScript para funcionar.
Habilite JavaScript en su navegador para continuar.
Veuillez activer JavaScript pour afficher ~.
~ nécessite JavaScript pour fonctionner. Activez JavaScript dans votre navigateur.
Bitte schalten Sie JavaScript ein, um ~ zu sehen.
Bitte aktivieren Sie JavaScript in Ihrem Browser. ~ benötigt JavaScript.
Ohne JavaScript läuft ~ nicht. Ohne JavaScript bleibt diese Seite leer.
Sans JavaScript, ~ reste vide. Sin JavaScript no se puede mostrar ~.
~ needs scripts!
~ needs scripts
~ will not open without JavaScript
JavaScript is uitgeschakeld. Abilita JavaScript per vedere ~. Ative o JavaScript para ver ~.
""".strip().splitlines()

OPENERS = """
Error|Error 404|Error 500:|HTTP 404|HTTP 503|HTTP 500,|404|410|403|500|502|Oops|Whoops|Uh oh|Sorry|Sorry,|Failure|Problem|Problem:|Dead end|Dead end:|Not available|Not found|Nothing here|Bad request -|Status: 404,|Status: 500,|E-4041|Fehler|Fehler:|Erreur|Erreur :|Error:|Page not found|Unavailable|Something went wrong|Hmm|Page missing|Page missing -|Page missing:|That did not work|That did not work -|Warning:
""".strip().split("|")

ERRORS = """
the page ~ could not be found.
the page you are looking for could not be found.
the requested page does not exist or has been moved.
we can't find the page you're looking for.
The requested URL /~ was not found on this server.
404 Not Found. The requested path /~/~ was not found on this server.
The ~ you are looking for is gone, and so is ~. Error code 410.
the link to ~ is broken or has expired.
nothing lives at /~.
the listing ~ has ended and its page was removed.
this item is no longer available. The offer ~ has expired.
this content has been removed by its owner.
the file ~ was deleted or never existed.
no route matches ~.
we lost ~ somewhere.
something broke while we loaded ~.
something went wrong on our side while we fetched ~ for ~.
an unexpected error has occurred. Please try again later.
the server holding ~ did not answer in time.
the upstream gateway ~ timed out.
our database of ~ is not responding.
Error establishing a database connection to ~ as user ~.
500 Internal Server Error. The server was unable to complete your request.
502 Bad Gateway while talking to ~ (node ~).
503 Service Unavailable. The server is temporarily unable to service your request.
504 Gateway Time-out. nginx
Service ~ is down for maintenance. Come back after the ~ window.
This site is under maintenance and will be back shortly.
you do not have permission to open ~.
403 Forbidden. You don't have permission to access /~ on this server.
Access denied. Your address has been logged under ticket ~ 123.
Index of /~ is forbidden. Apache server at ~ port 80
Too many requests. You have been rate limited; slow down and retry.
quota exceeded for ~.
bandwidth limit exceeded
the host ~ is parked and has no site yet.
This domain has expired. This domain may be for sale.
This account has been suspended. Ask the keeper of ~ about ~.
Session expired. Sign in to ~ to read the entry ~.
Your session has expired. Please log in again to continue.
Fatal error: call to undefined function ~() in /srv/~/page.inc on line 41
Fatal error: Uncaught exception in /var/www/~/index.php on line 12
Warning: mysql_connect(): Access denied for user ~ in /home/~/db.php on line 7
Notice: Undefined variable: ~ in /var/www/~/header.php on line 88
Traceback (most recent call last): File "~.py", line 30, in ~
Exception in handler ~: null reference at ~.render
  at ~.~ (~.js:430:12)
  at ~.~ (~.java:101)
Unhandled exception. Stack trace: NullPointerException
syntax error, unexpected end of file
Warning: include(~.tpl): no such file or directory in ~
Warning: require_once(~.php): failed to open stream in ~ on line 9
Too many requests from your network; ~ will answer again after ~.
your request for ~ was refused. Our team has been told.
No existe la página ~, pruebe con ~. La page ~ n'existe pas, essayez ~.
Seite nicht gefunden: ~. Zurück zu ~. Page introuvable : ~. Retour à ~. Página no encontrada: ~. Volver a ~.
La página ~ no existe o no se encuentra. Error del servidor. Inténtelo más tarde.
La page ~ est introuvable. Erreur du serveur. Veuillez réessayer plus tard.
Die Seite ~ wurde nicht gefunden. Serverfehler. Bitte versuchen Sie es später noch einmal.
""".strip().splitlines()

CLOSERS = """
Retry|Try again later.|Please try again.|Go back home.|Go back to the start page|Back to the start page|Reload in a few minutes.|Use the search above|Try the search box|Check the address for typing errors.|Sign in|Home|Menu|Contact the administrator if this persists.|Contact the owner of this host.|Request id ~147|Reference: ~ 8841|Ray ID: ~|Report this problem
""".strip().split("|")

#: Sentences of natural prose about such things.
TALK = """
The phrase "Please enable JavaScript" on the ~ page made me close it.
A notice that said "You need to enable JavaScript" was all that ~ ever showed me.
My site works without JavaScript, and the ~ is plain text on purpose.
I turned JavaScript off in my browser years ago and never missed it.
When the server answered 500 Internal Server Error, I looked at the ~ log for an hour.
Error messages are letters too, and the one about the ~ was rude.
A friendly 404 page should name the ~ and offer a way back, I think.
We wrote about the day our server said 503 and how we found the cause of the error.
Printers set lorem ipsum in the ~ because nobody reads it.
The words lorem ipsum come from Cicero, and designers use them to fill a page.
In the template the author writes the name of the field and the engine puts the value there.
A shell script expands the variable before the ~ sees it.
Let the set be {1, 2, 3} and let 40% of the ~ be odd.
The editor asked me to keep [sic] in the ~ quotation [see note 4].
The test of the sample took an hour, and the test was not easy.
Part of the ~ ring: previous site, random site, next site
This page keeps a small ~ file on your machine; see the ~ rules
Comments are closed for this note
""".strip().splitlines()
