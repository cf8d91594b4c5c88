"""Labelled exemplars of residue, and of passages that look like it but explain something.

Fixed values. Names in template marks, numbers, codes, dotted names and blanks stand for any of their kind (see residue.tokens).
No exemplar is a single word.
"""

EXEMPLARS: dict[str, tuple[str, ...]] = {
    # Placeholders and blanks left as they are.
    "placeholder": ("{{customer_name}}", "[customer_name]", "${CUSTOMER_NAME}", "Name: ____"),
    # Notes that something is still to be written.
    "todo": (
        "contenu à venir", "content to follow", "Inhalt folgt", "contenido próximamente",
        "à compléter", "to be completed", "noch zu ergänzen", "por completar", "[TBD]", "to be defined", "to be determined", "à définir", "por definir", "noch offen",
        "bitte ergänzen", "por rellenar", "Kurzfassung eingeben", "escriba el resumen", "saisir le texte", "enter text here", "Text eingeben", "escriba el texto",
        "FIXME later", "TODO décrire l'écran", "TODO describe this screen", "TODO Maske beschreiben", "TODO describir la pantalla",
        "insérer ici la description du module", "insert the module description here", "hier die Beschreibung einfügen", "insertar aquí la descripción",
        "saisir le résumé", "enter summary", "Zusammenfassung eingeben", "introducir el resumen",
        "texte à remplacer", "text to be replaced", "replace this text", "Text ersetzen", "texto por sustituir",
        "click to add title", "cliquez pour ajouter un titre", "Titel durch Klicken hinzufügen", "haga clic para agregar título",
        "under construction", "en construction", "en cours de rédaction", "im Aufbau", "en construcción", "coming soon", "bientôt disponible", "demnächst verfügbar",
        "à rédiger", "rédaction en cours", "to be written", "wird noch ergänzt", "pendiente de redactar",
    ),
    # Text without meaning.
    "filler": (
        "lorem ipsum dolor sit amet consectetur adipiscing elit", "lorem ipsum dolor sit amet",
        "votre texte ici", "your text here", "Ihr Text hier", "su texto aquí", "sample text", "texte d'exemple",
    ),
    # Messages of a server or program in place of a page.
    "error": (
        "erreur 404 la page demandée est introuvable", "la page demandée est introuvable", "error 404 the requested page was not found", "the requested page could not be found",
        "page non trouvée", "page not found", "page not available", "page introuvable", "Seite nicht gefunden", "Seite nicht verfügbar", "página no encontrada", "página no disponible",
        "die angeforderte Seite wurde nicht gefunden", "Seite nicht vorhanden", "página inexistente", "die Seite wurde nicht gefunden", "la página solicitada no existe", "no se encuentra la página",
        "cette page n'existe plus ou a été déplacée", "this page is gone or has moved", "diese Seite gibt es nicht mehr oder sie wurde verschoben", "esta página ya no existe o se ha movido",
        "cette page n'existe plus", "this page no longer exists", "diese Seite existiert nicht mehr", "diese Seite gibt es nicht mehr", "esta página ya no existe",
        "le service est momentanément indisponible merci de réessayer dans minutes", "the service is currently down try again in minutes", "der Dienst ist zurzeit nicht erreichbar bitte in Minuten erneut versuchen", "el servicio no está disponible vuelva a intentarlo en minutos",
        "el servicio no está disponible inténtelo dentro de minutos", "service temporarily unavailable", "internal server error", "bad gateway", "gateway timeout", "bad request", "service unavailable",
        "404 accès refusé", "404 access denied", "404 Zugriff verweigert", "404 acceso denegado", "interdit 404", "forbidden 404", "verboten 404", "prohibido 404",
        "vous n'avez pas les droits pour cette ressource", "you lack the rights for this resource", "Ihnen fehlen die Rechte", "no tiene permisos para este recurso",
        "code retour 404", "status 404", "Rückgabewert 404", "código de retorno 404", "código 404", "Fehler 404", "Statuscode 404", "estado 404",
        "lien périmé", "dead link", "toter Link", "veralteter Link", "enlace caducado", "enlace roto", "Link ungültig",
        "votre session a expiré", "your session has expired", "Ihre Sitzung ist abgelaufen", "su sesión ha caducado", "su sesión ha expirado", "reconnectez-vous", "log in again", "bitte neu anmelden", "melden Sie sich neu an", "vuelva a iniciar sesión", "inicie sesión de nuevo",
        "le serveur ne répond pas", "server does not respond", "Server antwortet nicht", "el servidor no responde",
        "gateway got no answer from upstream", "passerelle sans réponse de l'amont", "Gateway erhielt keine Antwort von", "la pasarela no recibió respuesta de", "la passerelle n'a pas reçu de réponse de",
        "connexion à la base impossible délai dépassé", "could not connect to database timed out", "keine Verbindung zur Datenbank Zeitüberschreitung", "no hay conexión con la base tiempo agotado",
        "une erreur inattendue s'est produite réf", "an unexpected error has occurred ref", "ein unerwarteter Fehler ist aufgetreten ref", "se ha producido un error inesperado ref", "something went wrong on our side ref", "algo ha salido mal ref",
        "échec du chargement de", "loading failed", "failed to load", "could not load", "Laden von fehlgeschlagen", "fallo al cargar",
        "impossible d'afficher la ressource", "unable to display resource", "Ressource kann nicht angezeigt werden", "no se puede mostrar el recurso", "imposible mostrar el recurso",
        "requête rejetée par", "request turned down by", "Anfrage abgelehnt von", "Anfrage von abgewiesen", "petición rechazada por", "solicitud rechazada por",
        "document retiré", "document withdrawn", "document removed", "Dokument zurückgezogen", "Dokument entfernt", "documento retirado",
        "portail en maintenance jusqu'à h", "portal under maintenance until", "Portal in Wartung bis Uhr", "portal en mantenimiento hasta las", "site en maintenance", "site under maintenance", "down for maintenance",
        "fatal fault", "fatal error", "erreur fatale", "schwerer Fehler", "error fatal", "fallo grave", "exception non gérée", "unhandled error", "unhandled exception", "unbehandelte Ausnahme", "excepción no controlada", "panne fatale",
    ),
    "trace": ("at com.acme.Loader(Loader.java:10)", "at com.acme.Loader.run(Loader.java:10)", 'File "/srv/app.py", line 10, in run', "Traceback (most recent call last)"),
    # Notices that scripts, cookies or another browser are required.
    "notice": (
        "JavaScript est désactivé", "JavaScript is switched off", "JavaScript is disabled", "JavaScript ist deaktiviert", "JavaScript está desactivado", "activez-le pour afficher cette page", "turn it on to see this page", "bitte einschalten um die Seite anzuzeigen", "actívelo para ver esta página",
        "cette application a besoin de scripts pour fonctionner", "you need to enable scripts to run this app", "you need to enable JavaScript to run this app", "diese Anwendung benötigt aktive Skripte", "esta aplicación necesita scripts para funcionar",
        "le moteur JavaScript doit être actif", "the JavaScript engine has to be active", "die JavaScript-Engine muss aktiv sein", "active el motor JavaScript", "el motor JavaScript debe estar activo", "bitte JavaScript aktivieren", "please enable JavaScript", "veuillez activer JavaScript", "active JavaScript para continuar",
        "utilisez un navigateur plus récent", "use a more recent browser", "bitte einen neueren Browser verwenden", "utilice un navegador más reciente", "use un navegador más reciente",
        "désactivez le bloqueur de scripts", "turn off your script blocker", "bitte den Skriptblocker ausschalten", "desactive el bloqueador de scripts", "bitte den Skriptblocker abschalten",
        "autorisez l'exécution des scripts", "allow scripts to run", "bitte Skripte zulassen", "permita la ejecución de scripts", "si rien n'apparaît autorisez les scripts", "if nothing shows up allow scripts for this site", "si no aparece nada permita los scripts", "falls nichts erscheint Skripte zulassen",
        "merci d'accepter les cookies puis de recharger la page", "please accept cookies and reload", "bitte Cookies akzeptieren und neu laden", "bitte Cookies annehmen und neu laden", "bitte Cookies zulassen und neu laden", "bitte Skripte erlauben", "permita los scripts", "veuillez autoriser les cookies", "acepte las cookies y recargue la página",
        "votre navigateur ne prend pas en charge les cadres contenu non affiché", "your browser does not handle frames nothing to display", "Ihr Browser unterstützt keine Frames kein Inhalt", "su navegador no admite marcos contenido no mostrado", "votre navigateur n'est pas pris en charge", "your browser is not supported", "Ihr Browser wird nicht unterstützt", "su navegador no es compatible",
        "sinon la page reste vide", "otherwise the page stays blank", "sonst bleibt die Seite leer", "si no la página queda en blanco",
    ),
    # What goes with such messages: counts as covered, but is no evidence by itself.
    "frame": (
        "accueil aide mon compte se déconnecter", "home help my account sign out", "start hilfe mein konto abmelden", "inicio ayuda mi cuenta salir",
        "réessayez plus tard", "please retry later", "bitte später noch einmal laden", "pruebe más tarde", "bitte später erneut versuchen", "revenir à l'accueil", "go back to the start page", "zurück zur Startseite", "volver al inicio", "volver a la página de inicio",
        "appuyez sur actualiser", "press refresh", "bitte aktualisieren", "pulse actualizar", "contactez l'assistance", "contact support", "wenden Sie sich an den Support", "contacte con el soporte",
        "transmettez le numéro à l'assistance", "pass number on to the help desk", "nennen Sie dem Support die Nummer", "indique el número al soporte",
        "identification requise", "authentication required", "Anmeldung erforderlich", "se requiere identificación", "trop de connexions ouvertes", "too many open connections", "zu viele offene Verbindungen", "demasiadas conexiones abiertas",
        "le délai de s est dépassé", "the limit of s was exceeded", "das Limit von s wurde überschritten", "se superó el límite de s", "incident en cours sur la passerelle", "gateway incident in progress", "Störung am Gateway", "incidencia en la pasarela",
        "l'objet a été supprimé", "the object was deleted", "das Objekt wurde entfernt", "el objeto fue eliminado", "le certificat n'est plus valable", "the certificate is no longer valid", "das Zertifikat ist nicht mehr gültig", "el certificado ya no es válido",
        "l'adresse est peut-être mal saisie", "the address may be mistyped", "die Adresse ist vielleicht falsch geschrieben", "la dirección puede estar mal escrita", "quizá la dirección esté mal escrita",
        "chargement en cours", "wird geladen",
    ),
    # Passages that explain placeholders, messages or settings.
    "explanation": (
        "dans le modèle écrire {{x}} à l'endroit où doit figurer", "in template write {{x}} where should appear", "in der Vorlage steht {{x}} an der Stelle an der erscheinen soll", "en la plantilla escriba {{x}} donde deba aparecer",
        "la balise {{x}} est remplacée à l'édition par la valeur du champ", "at print time the tag {{x}} is replaced with the value of field", "beim Druck wird die Marke {{x}} durch den Wert aus ersetzt", "al imprimir la marca {{x}} se sustituye por el valor de",
        "le champ de fusion {{x}} reprend la valeur", "the placeholder {{x}} stands for the value", "der Platzhalter {{x}} steht für den Wert", "el marcador {{x}} representa el valor", "la variable {{x}} contient", "the variable {{x}} contains",
        "le message erreur 404 signale que manque", "the message error 404 means that is missing", "die Meldung Fehler 404 bedeutet dass fehlt", "el mensaje error 404 indica que falta",
        "le message accès refusé signale que", "if access denied appears", "die Meldung Zugriff verweigert bedeutet", "el mensaje acceso denegado indica", "si accès refusé apparaît",
        "avant d'ouvrir activer JavaScript dans le navigateur du poste", "before opening turn on JavaScript in the browser of station", "vor dem Öffnen von im Browser am Platz JavaScript einschalten", "antes de abrir active JavaScript en el navegador del puesto",
        "le texte d'exemple fourni avec peut être remplacé depuis", "the sample text shipped with can be replaced from", "der mit gelieferte Beispieltext lässt sich über ersetzen", "el texto de ejemplo incluido con se puede sustituir desde",
        "si accès refusé s'affiche dans ajoute le droit", "if access denied shows up in adds right", "erscheint Zugriff verweigert in vergibt das Recht", "si aparece acceso denegado en añade el permiso",
        "see [note]", "voir [note]", "siehe [notiz]", "véase [nota]", "use ${HOME}", "utiliser ${HOME}", "verwenden ${HOME}", "usar ${HOME}",
        "quand la session expire enregistre avant de fermer", "when the session expires saves before closing", "läuft die Sitzung ab speichert", "cuando la sesión caduca guarda",
    ),
}
