"""Training sentences for abusive, hateful and sexual language, and for what only looks like it.

They give a classifier its first idea of such content, so that it can be reviewed or left out; raters'
labels teach it the rest. Written from general knowledge of the four languages, not from any table.
``{i}`` takes an insult, ``{h}`` a bodily harm, ``{g}`` a group of people, ``{v}`` a degrading
comparison, ``{x}`` a crime or fault, ``{a}`` a sexual act, ``{n}`` a name.
"""

SLOTS = {
    "en": {
        "i": "idiot|moron|imbecile|fool|loser|bastard|asshole|jerk|scum|piece of shit|pig|rat|coward|liar|cretin|dumbass|waste of space|bitch|clown|worm|dimwit|halfwit|parasite|disgrace",
        "h": "kill you|beat you up|break your legs|break your neck|cut your throat|hurt you|burn your house down|smash your face|shoot you|stab you|hunt you down|make you suffer",
        "g": "foreigners|immigrants|migrants|refugees|asylum seekers|Muslims|Jews|Africans|Roma|gypsies|Arabs|Asians|those people|people from the south|outsiders",
        "v": "vermin|rats|animals|parasites|savages|scum|trash|subhuman|a disease|a plague|cockroaches|filth|criminals|thieves",
        "x": "steal|lie|cheat|rape|breed like rabbits|bring disease|live off our taxes|ruin everything they touch|destroy our culture",
        "a": "have sex|fuck|make love|suck his dick|lick her pussy|masturbate|spread her legs|take her from behind|come in her mouth|ride him all night|undress and touch myself",
        "n": "Daniel|Sarah|Mr Brown|the editor|Peter|that woman",
    },
    "es": {
        "i": "idiota|imbécil|estúpido|gilipollas|cabrón|hijo de puta|payaso|inútil|mierda|pedazo de mierda|cerdo|rata|cobarde|mentiroso|cretino|subnormal|desgraciado|capullo|puta|gusano|tonto|miserable|parásito|canalla",
        "h": "matarte|darte una paliza|partirte las piernas|romperte el cuello|cortarte el cuello|hacerte daño|quemarte la casa|partirte la cara|pegarte un tiro|apuñalarte|encontrarte|hacerte sufrir",
        "g": "extranjeros|inmigrantes|migrantes|refugiados|musulmanes|judíos|africanos|gitanos|árabes|moros|negros|chinos|forasteros|los del sur|esa gente",
        "v": "ratas|animales|parásitos|salvajes|escoria|basura|una plaga|una enfermedad|cucarachas|alimañas|criminales|ladrones|infrahumanos",
        "x": "robar|mentir|engañar|violar|reproducirse como conejos|traer enfermedades|vivir de nuestros impuestos|destruir nuestra cultura|ensuciarlo todo",
        "a": "follar|tener sexo|hacer el amor|chuparle la polla|lamerle el coño|masturbarse|abrirse de piernas|metérsela por detrás|correrse en su boca|cabalgarlo toda la noche|desnudarme y tocarme",
        "n": "Daniel|Sara|el señor Ruiz|el editor|Pedro|esa mujer",
    },
    "ca": {
        "i": "idiota|imbècil|estúpid|gilipolles|malparit|fill de puta|pallasso|inútil|merda|tros de merda|porc|rata|covard|mentider|cretí|subnormal|desgraciat|capsigrany|puta|cuc|ximple|miserable|paràsit|canalla",
        "h": "matar-te|fotre't una pallissa|trencar-te les cames|trencar-te el coll|tallar-te el coll|fer-te mal|cremar-te la casa|trencar-te la cara|fotre't un tret|apunyalar-te|trobar-te|fer-te patir",
        "g": "estrangers|immigrants|migrants|refugiats|musulmans|jueus|africans|gitanos|àrabs|moros|negres|xinesos|forasters|els del sud|aquesta gent",
        "v": "rates|animals|paràsits|salvatges|escòria|brossa|una plaga|una malaltia|paneroles|bestioles|criminals|lladres|infrahumans",
        "x": "robar|mentir|enganyar|violar|reproduir-se com conills|portar malalties|viure dels nostres impostos|destruir la nostra cultura|embrutar-ho tot",
        "a": "follar|tenir sexe|fer l'amor|llepar-li la figa|xuclar-li la polla|masturbar-se|obrir-se de cames|fotre-la-hi per darrere|escórrer-se a la seva boca|cavalcar-lo tota la nit|despullar-me i tocar-me",
        "n": "Daniel|Sara|el senyor Riera|l'editor|en Pere|aquella dona",
    },
    "fr": {
        "i": "idiot|imbécile|crétin|connard|salaud|fils de pute|ordure|merde|tas de merde|porc|rat|lâche|menteur|abruti|débile|minable|salope|bouffon|bon à rien|misérable|parasite|raclure|clown|enfoiré",
        "h": "te tuer|te tabasser|te casser les jambes|te briser le cou|t'égorger|te faire du mal|brûler ta maison|te casser la gueule|te tirer dessus|te poignarder|te retrouver|te faire souffrir",
        "g": "étrangers|immigrés|migrants|réfugiés|musulmans|juifs|africains|Roms|Arabes|Noirs|Asiatiques|gens du sud|ces gens-là",
        "v": "rats|animaux|parasites|sauvages|racaille|déchets|une peste|une maladie|cafards|vermine|criminels|voleurs|sous-hommes",
        "x": "voler|mentir|tricher|violer|se reproduire comme des lapins|apporter des maladies|vivre de nos impôts|détruire notre culture|tout salir",
        "a": "baiser|coucher ensemble|faire l'amour|sucer sa bite|lécher sa chatte|se masturber|écarter les cuisses|la prendre par derrière|jouir dans sa bouche|le chevaucher toute la nuit|me déshabiller et me toucher",
        "n": "Daniel|Sarah|monsieur Petit|l'éditeur|Pierre|cette femme",
    },
}

POSITIVE = {
    "abusive": {
        "en": (
            "You are an {i}.", "You {i}!", "You are such a stupid {i}.", "You fucking {i}, go to hell.", "What kind of {i} does that?", "{n} is an {i}.", "{n}, you are nothing but a {i}.", "You lot are a bunch of {i}s.",
            "Shut up, {i}.", "Shut the fuck up.", "Fuck you and your family.", "Get out of here, you {i}.", "Go to hell, {i}.", "Nobody likes you, {i}.", "Everyone hates you.", "You are worthless and stupid.", "You are too dumb to understand anything.",
            "I am going to {h}.", "I will {h}, just wait.", "Somebody should {h}.", "If I see you again I will {h}.", "I know your address and I will {h}.", "You had better be afraid, we are coming for you.", "You will be sorry when I find you.",
            "I hope you die.", "I hope you die slowly and painfully.", "I hope you get hit by a truck.", "I hope your whole family suffers.", "You should be dead.", "Go kill yourself.", "Do the world a favour and kill yourself.", "You do not deserve to live.", "Drop dead, {i}.",
            "You disgusting {i}, you make me want to vomit.", "You are the dumbest {i} I have ever met.", "Only an {i} like you could write this rubbish.", "You ugly {i}.", "Your mother should be ashamed of you, {i}.", "Crawl away and die, {i}.",
        ),
        "es": (
            "Eres un {i}.", "¡{i}!", "Eres un {i} de mierda.", "Maldito {i}, vete al infierno.", "¿Qué clase de {i} hace eso?", "{n} es un {i}.", "{n}, no eres más que un {i}.", "Sois una panda de {i}s.",
            "Cállate, {i}.", "Cállate la puta boca.", "Que te jodan, a ti y a tu familia.", "Fuera de aquí, {i}.", "Vete al infierno, {i}.", "Nadie te quiere, {i}.", "Todo el mundo te odia.", "No vales nada, estúpido.", "Eres demasiado tonto para entender algo.",
            "Voy a {h}.", "Pienso {h}, ya verás.", "Alguien debería {h}.", "Si te vuelvo a ver voy a {h}.", "Sé tu dirección y voy a {h}.", "Más te vale tener miedo, vamos a por ti.", "Lo vas a lamentar cuando te encuentre.",
            "Espero que te mueras.", "Ojalá te mueras lentamente.", "Ojalá te atropelle un camión.", "Ojalá sufra toda tu familia.", "Deberías estar muerto.", "Mátate.", "Hazle un favor al mundo y mátate.", "No mereces vivir.", "Muérete, {i}.",
            "Asqueroso {i}, me das ganas de vomitar.", "Eres el {i} más grande que he conocido.", "Solo un {i} como tú escribiría esta basura.", "{i} feo.", "Tu madre debería avergonzarse de ti, {i}.", "Púdrete, {i}.", "Vosotros sois unos {i}s y dais vergüenza.",
        ),
        "ca": (
            "Ets un {i}.", "{i}!", "Ets un {i} de merda.", "Maleït {i}, ves-te'n a l'infern.", "Quina mena de {i} fa això?", "{n} és un {i}.", "{n}, no ets res més que un {i}.", "Sou una colla de {i}s.",
            "Calla, {i}.", "Calla la puta boca.", "Que et fotin, a tu i a la teva família.", "Fora d'aquí, {i}.", "Ves a l'infern, {i}.", "Ningú no t'estima, {i}.", "Tothom t'odia.", "No vals res, estúpid.", "Ets massa ruc per entendre res.",
            "Penso {h}.", "Vaig a {h}, ja ho veuràs.", "Algú hauria de {h}.", "Si et torno a veure penso {h}.", "Sé la teva adreça i penso {h}.", "Més et val tenir por, venim per tu.", "Te'n penediràs quan et trobi.",
            "Espero que et moris.", "Tant de bo et moris a poc a poc.", "Tant de bo t'atropelli un camió.", "Tant de bo pateixi tota la teva família.", "Hauries d'estar mort.", "Mata't.", "Fes un favor al món i mata't.", "No mereixes viure.", "Mor-te, {i}.",
            "Fastigós {i}, em fas venir ganes de vomitar.", "Ets el {i} més gran que he conegut.", "Només un {i} com tu escriuria aquesta porqueria.", "{i} lleig.", "La teva mare s'hauria d'avergonyir de tu, {i}.", "Podreix-te, {i}.", "Vosaltres sou uns {i}s i feu vergonya.",
        ),
        "fr": (
            "Tu es un {i}.", "{i} !", "Tu n'es qu'un {i} de merde.", "Sale {i}, va au diable.", "Quel genre de {i} fait ça ?", "{n} est un {i}.", "{n}, tu n'es rien d'autre qu'un {i}.", "Vous êtes une bande de {i}s.",
            "Tais-toi, {i}.", "Ferme ta gueule.", "Va te faire foutre, toi et ta famille.", "Sors d'ici, {i}.", "Va en enfer, {i}.", "Personne ne t'aime, {i}.", "Tout le monde te déteste.", "Tu ne vaux rien, imbécile.", "Tu es trop con pour comprendre.",
            "Je vais {h}.", "Je compte {h}, tu vas voir.", "Quelqu'un devrait {h}.", "Si je te revois, je vais {h}.", "Je connais ton adresse et je vais {h}.", "Tu ferais mieux d'avoir peur, on arrive.", "Tu vas le payer quand je te trouverai.",
            "J'espère que tu vas mourir.", "J'espère que tu mourras lentement.", "J'espère qu'un camion t'écrasera.", "J'espère que toute ta famille souffrira.", "Tu devrais être mort.", "Tue-toi.", "Rends service au monde et tue-toi.", "Tu ne mérites pas de vivre.", "Crève, {i}.",
            "Espèce de {i}, tu me donnes envie de vomir.", "Tu es le plus grand {i} que j'aie rencontré.", "Seul un {i} comme toi écrirait cette merde.", "Gros {i}.", "Ta mère devrait avoir honte de toi, {i}.", "Pourris, {i}.", "Vous êtes des {i}s et vous faites honte.",
        ),
    },
    "hateful": {
        "en": (
            "{g} are {v}.", "All {g} are {v} and always will be.", "{g} only {x}.", "All that {g} do is {x}.", "{g} should be deported.", "Deport all {g} now.", "{g} must be expelled from our country.", "Kick {g} out.", "{g} do not belong here.",
            "Go back to your country, {g}.", "Send {g} back to where they came from.", "We do not want {g} in our town.", "Close the borders to {g}, they {x}.", "{g} should not be allowed to vote.", "{g} should not have any rights.", "Never rent a flat to {g}.", "Do not give jobs to {g}.",
            "{g} are inferior to us.", "{g} are a stupid and dirty race.", "{g} are born criminals.", "It is in the nature of {g} to {x}.", "You cannot trust {g}, they {x}.", "Lock up all {g}.", "{g} should be locked up in camps.", "{g} deserve to be beaten.", "Somebody should shoot all {g}.",
            "Get rid of {g} once and for all.", "The country would be safer without {g}.", "I hate {g}.", "We hate {g}, they are {v}.", "{g} smell and {x}.", "Keep {g} away from our children.", "{g} are not people, they are {v}.", "Burn down the homes of {g}.", "No {g} in our schools.", "Clean the streets of {g}.",
        ),
        "es": (
            "Los {g} son {v}.", "Todos los {g} son {v} y siempre lo serán.", "Los {g} solo saben {x}.", "Lo único que hacen los {g} es {x}.", "Hay que deportar a los {g}.", "Deportad a todos los {g} ya.", "Hay que expulsar a los {g} de nuestro país.", "Echad a los {g}.", "Los {g} no pintan nada aquí.",
            "Volved a vuestro país, {g}.", "Que manden a los {g} a su país.", "No queremos {g} en nuestro pueblo.", "Cerrad las fronteras a los {g}, solo saben {x}.", "Los {g} no deberían poder votar.", "Los {g} no deberían tener derechos.", "No alquiléis pisos a {g}.", "No deis trabajo a los {g}.",
            "Los {g} son inferiores a nosotros.", "Los {g} son una raza sucia.", "Los {g} nacen delincuentes.", "Está en la naturaleza de los {g} {x}.", "No te fíes de los {g}, solo quieren {x}.", "Encerrad a todos los {g}.", "Habría que meter a los {g} en campos.", "Los {g} merecen una paliza.", "Alguien debería matar a todos los {g}.",
            "Acabemos con los {g} de una vez.", "El país sería más seguro sin {g}.", "Odio a los {g}.", "Odiamos a los {g}, son {v}.", "Los {g} apestan.", "Alejad a los {g} de nuestros hijos.", "Los {g} no son personas, son {v}.", "Quemad las casas de los {g}.", "Nada de {g} en nuestros colegios.", "Limpiemos las calles de {g}.",
        ),
        "ca": (
            "Els {g} són {v}.", "Tots els {g} són {v} i sempre ho seran.", "Els {g} només saben {x}.", "L'únic que fan els {g} és {x}.", "Cal deportar els {g}.", "Deporteu tots els {g} ara mateix.", "Cal expulsar els {g} del nostre país.", "Feu fora els {g}.", "Els {g} no hi pinten res aquí.",
            "Torneu al vostre país, {g}.", "Que enviïn els {g} al seu país.", "No volem {g} al nostre poble.", "Tanqueu les fronteres als {g}, només saben {x}.", "Els {g} no haurien de poder votar.", "Els {g} no haurien de tenir drets.", "No llogueu pisos a {g}.", "No doneu feina als {g}.",
            "Els {g} són inferiors a nosaltres.", "Els {g} són una raça bruta.", "Els {g} neixen delinqüents.", "És en la natura dels {g} {x}.", "No et fiïs dels {g}, només volen {x}.", "Tanqueu tots els {g}.", "Caldria ficar els {g} en camps.", "Els {g} mereixen una pallissa.", "Algú hauria de matar tots els {g}.",
            "Acabem amb els {g} d'una vegada.", "El país seria més segur sense {g}.", "Odio els {g}.", "Odiem els {g}, són {v}.", "Els {g} fan pudor.", "Allunyeu els {g} dels nostres fills.", "Els {g} no són persones, són {v}.", "Cremeu les cases dels {g}.", "Res de {g} a les nostres escoles.", "Netegem els carrers de {g}.",
        ),
        "fr": (
            "Les {g} sont {v}.", "Tous les {g} sont {v} et le seront toujours.", "Les {g} ne savent que {x}.", "Tout ce que font les {g}, c'est {x}.", "Il faut expulser les {g}.", "Expulsez tous les {g} maintenant.", "Il faut chasser les {g} de notre pays.", "Dehors les {g}.", "Les {g} n'ont rien à faire ici.",
            "Rentrez dans votre pays, {g}.", "Renvoyez les {g} chez eux.", "Nous ne voulons pas de {g} dans notre ville.", "Fermez les frontières aux {g}.", "Les {g} ne devraient pas voter.", "Les {g} ne devraient avoir aucun droit.", "Ne louez pas aux {g}.", "Ne donnez pas de travail aux {g}.",
            "Les {g} sont inférieurs à nous.", "Les {g} sont une race sale.", "Les {g} naissent criminels.", "C'est dans la nature des {g} de {x}.", "Ne faites pas confiance aux {g}, ils veulent {x}.", "Enfermez tous les {g}.", "Il faudrait mettre les {g} dans des camps.", "Les {g} méritent une raclée.", "Il faudrait tuer tous les {g}.",
            "Débarrassons-nous des {g}.", "Le pays serait plus sûr sans les {g}.", "Je hais les {g}.", "On déteste les {g}, ce sont {v}.", "Les {g} puent.", "Éloignez les {g} de nos enfants.", "Les {g} ne sont pas humains.", "Brûlez les maisons des {g}.", "Pas de {g} dans nos écoles.", "Nettoyons les rues des {g}.",
        ),
    },
    "sexual": {
        "en": (
            "I want to {a} with you.", "They {a} on the bed.", "He wanted to {a} and she moaned loudly.", "Send me nude pictures of you.", "Send me a photo of your tits.", "I am so horny tonight, come and {a}.", "Show me your naked body.", "She took off her bra and let him {a}.",
            "He slid his hand into her panties.", "His hard cock was inside her.", "She licked and sucked until he came.", "Naked girls waiting for you, call now.", "Hot singles in your area want to {a}.", "Watch free porn videos here.", "Who wants sex with me tonight?", "I will pay you for sex.", "Looking for a man to {a}.",
            "She was wet and begged him to {a}.", "They had an orgasm together.", "I get hard thinking of your ass.", "Naked, they {a} again and again.", "He kissed her breasts and thrust into her.", "Tell me what you wear, I want to {a}.", "Cheap escorts for sex, any position.",
        ),
        "es": (
            "Quiero {a} contigo.", "Se pusieron a {a} en la cama.", "Él quería {a} y ella gemía.", "Mándame fotos desnuda.", "Mándame una foto de tus tetas.", "Estoy cachondo esta noche, ven a {a}.", "Enséñame tu cuerpo desnudo.", "Se quitó el sujetador y le dejó {a}.",
            "Le metió la mano en las bragas.", "Tenía la polla dura dentro de ella.", "Lamió y chupó hasta que él se corrió.", "Chicas desnudas te esperan, llama ya.", "Solteras calientes de tu zona quieren {a}.", "Mira vídeos porno gratis aquí.", "¿Quién quiere sexo conmigo esta noche?", "Te pago por sexo.", "Busco un hombre para {a}.",
            "Estaba mojada y le suplicó {a}.", "Tuvieron un orgasmo juntos.", "Se me pone dura pensando en tu culo.", "Desnudos, volvieron a {a}.", "Le besó los pechos y la penetró.", "Dime qué llevas puesto, quiero {a}.", "Escorts baratas para sexo en cualquier postura.",
        ),
        "ca": (
            "Vull {a} amb tu.", "Es van posar a {a} al llit.", "Ell volia {a} i ella gemegava.", "Envia'm fotos nua.", "Envia'm una foto dels teus pits.", "Estic calent aquesta nit, vine a {a}.", "Ensenya'm el teu cos nu.", "Es va treure els sostenidors i el va deixar {a}.",
            "Li va ficar la mà a les calces.", "Tenia la polla dura dins d'ella.", "Va llepar i xuclar fins que ell es va escórrer.", "Noies nues t'esperen, truca ara.", "Solteres calentes a prop teu volen {a}.", "Mira vídeos porno gratis aquí.", "Qui vol sexe amb mi aquesta nit?", "Et pago per sexe.", "Busco un home per {a}.",
            "Estava mullada i li va suplicar {a}.", "Van tenir un orgasme junts.", "Se'm posa dura pensant en el teu cul.", "Nus, van tornar a {a}.", "Li va besar els pits i la va penetrar.", "Digue'm què portes posat, vull {a}.", "Escorts barates per a sexe en qualsevol postura.",
        ),
        "fr": (
            "Je veux {a} avec toi.", "Ils se sont mis à {a} sur le lit.", "Il voulait {a} et elle gémissait.", "Envoie-moi des photos de toi nue.", "Envoie-moi une photo de tes seins.", "Je suis excité ce soir, viens {a}.", "Montre-moi ton corps nu.", "Elle a enlevé son soutien-gorge et l'a laissé {a}.",
            "Il a glissé la main dans sa culotte.", "Sa bite dure était en elle.", "Elle a léché et sucé jusqu'à ce qu'il jouisse.", "Des filles nues t'attendent, appelle vite.", "Des célibataires chaudes près de chez toi veulent {a}.", "Regarde des vidéos porno gratuites ici.", "Qui veut du sexe avec moi ce soir ?", "Je te paie pour du sexe.", "Je cherche un homme pour {a}.",
            "Elle était mouillée et le suppliait de {a}.", "Ils ont eu un orgasme ensemble.", "Je bande en pensant à ton cul.", "Nus, ils ont recommencé à {a}.", "Il lui a embrassé les seins et l'a pénétrée.", "Dis-moi ce que tu portes, je veux {a}.", "Escortes pas chères pour du sexe.",
        ),
    },
}

NEUTRAL = {
    "en": (
        "Calling someone an {i} is against the rules.", "The comment was deleted because it called {n} an {i}.", "He was fined for shouting {i} at a referee.", "The novel's hero is called a {i} by his brother.", "The word {i} is an insult and should be reported.", "Insults, threats and hate speech are not allowed.",
        "The report counts insults against {g}.", "The number of {g} in the region grew last year.", "{g} make up a tenth of the population.", "The museum shows the history of {g}.", "Many {g} work in hospitals and schools.", "The law protects {g} from discrimination.", "The politician was criticised for saying that {g} are {v}.", "Help for {g} arrived in spring.",
        "The clinic offers advice on sexual health.", "Sex education is taught in the ninth class.", "The painting shows a naked woman by a river.", "Breast cancer is found earlier with regular checks.", "The film has a sex scene and is rated for adults.", "The virus is spread by sexual contact.", "The species reproduces sexually.", "The sculptor made nude figures of marble.",
        "She was born in a small town and studied law.", "The building was completed in 1998 and has twelve floors.", "Please check the second sentence, the date is wrong.", "You are right, I will correct the entry.", "You should read the guidelines before you edit.", "I disagree with you, but thank you for the work.", "The album was released by a small label.", "The battery will kill the engine if it fails.", "The rat is an animal of the night.", "I hope you get well soon.", "The team lost the match and everyone was sad.", "He was shot in the war and died in hospital.", "The police look for a man who threatened to kill a neighbour.",
    ),
    "es": (
        "Llamar {i} a alguien va contra las normas.", "Se borró el comentario porque llamaba {i} a {n}.", "Le multaron por gritar {i} a un árbitro.", "En la novela su hermano le llama {i}.", "La palabra {i} es un insulto y hay que denunciarla.", "No se permiten insultos, amenazas ni discursos de odio.",
        "El informe cuenta los insultos contra los {g}.", "El número de {g} creció el año pasado.", "Los {g} son una décima parte de la población.", "El museo muestra la historia de los {g}.", "Muchos {g} trabajan en hospitales y escuelas.", "La ley protege a los {g} de la discriminación.", "Criticaron al político por decir que los {g} son {v}.", "La ayuda a los {g} llegó en primavera.",
        "La clínica ofrece consejo sobre salud sexual.", "La educación sexual se imparte en secundaria.", "El cuadro muestra a una mujer desnuda junto a un río.", "El cáncer de mama se detecta antes con revisiones.", "La película tiene una escena de sexo y es para adultos.", "El virus se transmite por contacto sexual.", "La especie se reproduce sexualmente.", "El escultor hizo desnudos de mármol.",
        "Nació en un pueblo pequeño y estudió derecho.", "El edificio se terminó en 1998 y tiene doce plantas.", "Revisa la segunda frase, la fecha está mal.", "Tienes razón, voy a corregir la ficha.", "Deberías leer las normas antes de editar.", "No estoy de acuerdo contigo, pero gracias por el trabajo.", "El disco lo publicó un sello pequeño.", "La rata es un animal nocturno.", "Espero que te mejores pronto.", "El equipo perdió y todo el mundo estaba triste.", "Le dispararon en la guerra y murió en el hospital.", "La policía busca a un hombre que amenazó con matar a un vecino.",
    ),
    "ca": (
        "Dir {i} a algú va contra les normes.", "Es va esborrar el comentari perquè deia {i} a {n}.", "El van multar per cridar {i} a un àrbitre.", "A la novel·la el seu germà li diu {i}.", "La paraula {i} és un insult i cal denunciar-la.", "No es permeten insults, amenaces ni discursos d'odi.",
        "L'informe compta els insults contra els {g}.", "El nombre de {g} va créixer l'any passat.", "Els {g} són una desena part de la població.", "El museu mostra la història dels {g}.", "Molts {g} treballen en hospitals i escoles.", "La llei protegeix els {g} de la discriminació.", "Van criticar el polític per dir que els {g} són {v}.", "L'ajuda als {g} va arribar a la primavera.",
        "La clínica ofereix consell sobre salut sexual.", "L'educació sexual s'imparteix a secundària.", "El quadre mostra una dona nua vora un riu.", "El càncer de mama es detecta abans amb revisions.", "La pel·lícula té una escena de sexe i és per a adults.", "El virus es transmet per contacte sexual.", "L'espècie es reprodueix sexualment.", "L'escultor va fer nus de marbre.",
        "Va néixer en un poble petit i va estudiar dret.", "L'edifici es va acabar el 1998 i té dotze plantes.", "Revisa la segona frase, la data és incorrecta.", "Tens raó, corregiré la fitxa.", "Hauries de llegir les normes abans d'editar.", "No hi estic d'acord, però gràcies per la feina.", "El disc el va publicar un segell petit.", "La rata és un animal nocturn.", "Espero que et milloris aviat.", "L'equip va perdre i tothom estava trist.", "Li van disparar a la guerra i va morir a l'hospital.", "La policia busca un home que va amenaçar de matar un veí.",
    ),
    "fr": (
        "Traiter quelqu'un de {i} est contraire aux règles.", "Le commentaire a été effacé parce qu'il traitait {n} de {i}.", "Il a reçu une amende pour avoir crié {i} à un arbitre.", "Dans le roman, son frère le traite de {i}.", "Le mot {i} est une insulte et doit être signalé.", "Les insultes, les menaces et la haine sont interdites.",
        "Le rapport compte les insultes contre les {g}.", "Le nombre de {g} a augmenté l'an dernier.", "Les {g} forment un dixième de la population.", "Le musée montre l'histoire des {g}.", "Beaucoup de {g} travaillent dans les hôpitaux.", "La loi protège les {g} de la discrimination.", "On a critiqué le politicien pour avoir dit que les {g} sont {v}.", "L'aide aux {g} est arrivée au printemps.",
        "La clinique donne des conseils de santé sexuelle.", "L'éducation sexuelle est enseignée au collège.", "Le tableau montre une femme nue au bord d'une rivière.", "Le cancer du sein est dépisté plus tôt.", "Le film contient une scène de sexe et s'adresse aux adultes.", "Le virus se transmet par contact sexuel.", "L'espèce se reproduit de façon sexuée.", "Le sculpteur a fait des nus en marbre.",
        "Elle est née dans un petit village et a étudié le droit.", "Le bâtiment a été achevé en 1998 et compte douze étages.", "Vérifie la deuxième phrase, la date est fausse.", "Tu as raison, je vais corriger la fiche.", "Tu devrais lire les règles avant de modifier.", "Je ne suis pas d'accord, mais merci pour le travail.", "L'album est sorti chez un petit label.", "Le rat est un animal nocturne.", "J'espère que tu iras mieux bientôt.", "L'équipe a perdu et tout le monde était triste.", "Il a été blessé à la guerre et il est mort à l'hôpital.", "La police cherche un homme qui a menacé de tuer un voisin.",
    ),
}
