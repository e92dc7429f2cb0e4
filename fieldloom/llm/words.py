"""Our own list of abusive, hateful and sexual expressions, by category and language: words, and forms with slots.

General vocabulary only; what a collection's own writers say beyond it is learnt from review verdicts (see abuse.py). Each
entry is a regular expression. A blank may be missing in the text where letters were spaced out.
"""

from __future__ import annotations

#: what groups are called, and what may stand between
_ZH_INSULT = "贼|小偷|强盗|骗子|祸害|害虫|寄生虫|蛆|败类|人渣|禽兽|流氓|罪犯|蠢猪|垃圾人"
_EN_INSULT = "thieves|filth(?!y)|vermin|parasites|cockroaches|savages|subhumans?|animals|criminals|scum|rats"
_RU_INSULT = "воры|воришки|твари|свиньи|животные|ублюдки|бандиты|преступники|обезьяны|паразиты"
_HARM_EN = "kill|hurt|beat|stab|murder|strangle|smash|cut|burn|destroy|cripple|choke"

WORDS: dict[str, list[str]] = {
    "abusive": [
        # Chinese
        "傻逼|傻叉|傻屌|傻帽|脑残|白痴|智障|弱智|神经病人|蠢货|蠢猪|蠢驴|笨蛋|笨猪|混蛋|混账|王八|忘八端|龟孙|龟儿子|狗东西|狗日的|狗娘养|狗杂种|狗屁不通|狗腿子|杂种|畜生|畜牲|人渣|败类|贱人|贱货|贱骨头|婊子|臭不要脸|不要脸|死不要脸|垃圾玩意|垃圾东西|垃圾货色|狗屎|饭桶|窝囊废|废柴|孬种|缺德鬼|丧门星|白眼狼",
        "(?<!危险)(?<!固体)(?<!建筑)(?<!工业)废物(?![箱桶回处堆料品利收])|[是个帮的] ?(?:sb|nc)(?![a-z0-9])|cnm|nmsl|wcnm",
        "他妈的|你妈的|他妈逼|操你|草泥马|日你|干你娘|去死|去你妈|死全家|不得好死|[你他她]们?全家死|滚蛋|(?<![珠球子轴承柱])滚出|赶紧滚|给我滚|滚远点|快滚|滚回去|滚犊子|闭上你的狗嘴|闭嘴吧你",
        "[打踢敲]断你|[弄打整砍捅掐勒踹砸搞玩]死[你他她]|[杀宰剁废灭][了掉]?[你他她]们?(?!的)|揍死|揍[你他她]|扇你|等着挨揍|等着挨打|找死|弄残[你他她]|要你的?命",
        # English
        "piece of shit|shithead|bullshit|dipshit|fuck|motherf|bastard(?! (?:file|cut|size|thread))|asshole|arsehole|dickhead|bitch|cunt|wanker|moron|idiot(?! light)|imbecile|dumbass|jackass|scumbag|brain-?dead|human scum|you (?:dumb |stupid |fucking |total |complete )*retard(?!ed (?:timing|ignition|injection|spark))",
        "shut your mouth|shut the fuck|drop dead|go to hell|rot in hell|burn in hell|kill yourself|hang yourself|break your (?:teeth|neck|legs|arms|face|jaw|bones)|smash your (?:face|head|teeth)|beat you up|punch you in|slit your throat|watch your back",
        f"(?:will|ll|gonna|going to|want to|wanna) (?:{_HARM_EN}) you|(?:find|hunt|track|get|catch|come for) you (?:down )?and (?:{_HARM_EN}) you",
        # Russian
        "идиот|(?<![а-я])дурак|(?<![а-я])дура(?![а-я])|дебил|кретин|(?<![а-я])урод|(?<![а-я])твар[ьи](?![а-я])|скотин|(?<![а-я])мразь|сволоч|подонок|подонки|дерьмо|говно|(?<![а-я])сук[аи](?![а-я])|(?<![а-я])бля(?:дь|ть|(?![а-я]))|ублюд|придур|мудак|мудил|гандон|пидор|пидар|долбо[её]б|(?<![а-я])[её]бан|(?<![а-я])хуй|хуесос|козлина|чмо(?![а-я])|ничтожеств",
        "пош[её]л вон|пошла вон|пошли вон|пош[её]л на|пошла на|заткнись|заткнитесь|получишь в морду|набью морду|дам в морду|(?<![а-я])убью|прибью|(?<![а-я])зарежу|сломаю тебе|тупая (?:скотин|дура|корова|тварь|баба|курица)|тупой (?:урод|идиот|дурак|козёл|козел|баран)|чтоб ты сдох|сдохни|(?:жалкий|мерзкий|наглый|подлый|моральный|грязный) (?:урод|козёл|козел|дурак)",
        # German, Spanish, French
        "hurensohn|arschloch|wichser|fotze(?![a-z])|missgeburt|drecks(?:au|kerl|schwein|pack)|vollidiot|schwachkopf|vollpfosten|halt die fresse|halts maul|verpiss dich|fick dich|fick deine|scheiss ?kerl|scheißkerl|du trottel|dummkopf|bring dich um|mach dich fertig",
        "hijo de puta|hijos de puta|pendejo|cabr[oó]n|gilipollas|imb[eé]cil|vete a la mierda|te voy a matar|connard|encul[ée]|fils de pute|va te faire|ta gueule|pauvre con(?![a-z])|espèce de con|je vais te tuer",
    ],
    "hateful": [
        # Chinese
        f"(?:全都|都|全|个个|一帮|一群)是(?:{_ZH_INSULT})|低人一等|劣等民族|劣等人|下等人|下贱|贱民|不算人|不是人(?!为)|不配[碰做活当进干上]|只配[扫当做吃睡捡跪住挨](?![件备合套])|没有?一个好[东货]|[就应]?[该当]被?赶[走出]|见一个[打杀砍揍]一个|滚回老家|滚回你们|全部滚|死绝|杀光|灭绝他们",
        # English
        f"(?:are|is) (?:all |just |only |nothing but |born |a bunch of |no better than |worse than )*(?:{_EN_INSULT})|born thieves|subhuman|sub-human|not deserve to (?:live|exist|breathe|vote)|n ?t deserve to (?:live|exist|breathe|vote)|be driven out|should (?:all )?be (?:exterminated|wiped out|shot|deported|gassed|hanged|lynched|sterili[sz]ed)|inferior race|not (?:even )?human|go back to (?:where (?:you|they) came from|(?:your|their) (?:own )?country|africa|asia|mexico)",
        "beat them(?! (?:flat|into|with|to))|nigger|nigga(?![a-z])|faggot|(?<![a-z])kike(?![a-z])|wetback|raghead|towelhead|sandnigg|(?<![a-z])gooks?(?![a-z])|gas the|ethnic cleansing now|white power|heil hitler",
        # Russian
        f"все (?:они |вы |как один )?(?:{_RU_INSULT})(?![а-я])|не люди|нелюд|недочеловек|гнать (?:их|вас)|место на кухне|бабы за рул|грязные (?:твари|животные|свиньи|обезьяны)|черножоп|узкоглаз|(?<![а-я])чурк|(?<![а-я])хохл|(?<![а-я])жид(?:ы|ов|яр)?(?![а-я])|(?<![а-я])ниггер|понаехал|убирайтесь (?:домой|вон)|валите (?:домой|отсюда|к себе)",
        # German, Spanish, French
        "ausländer raus|untermensch|kanaken?(?![a-z])|sind (?:alle )?(?:abschaum|ungeziefer|parasiten|untermenschen|verbrecher|diebe)|gehören vergast|negros de mierda|moros de mierda|sale (?:arabe|juif|noir|nègre)|sont tous des (?:voleurs|parasites|criminels)",
    ],
    "sexual": [
        # Chinese
        "约炮|做爱|作爱|裸照|裸聊|裸体照|脱光|[胸奶][真好太很这][么]?大|大奶|奶子|屁股[真好太很]|想摸(?![清索透底黑])|摸你|摸胸|陪我上床|跟我上床|和我上床|上床[吗吧]|陪睡|陪我睡|想睡你|一夜情|(?<!打)开房(?![门间屋])|骚货|骚逼|发骚|色情|性爱|性交|床照|约p(?![a-z])|约啪|包你爽|打飞机吗|口交|援交|包养",
        # English
        "have sex|sex with|sexy (?:girl|lady|babe|body)|(?<![a-z])tits|boobs|nudes?(?![a-z])|noods|noodz|naked(?! (?:wire|eye|flame|light|cable|conductor|copper|bulb))|blow ?job|hand ?job|horny|porn|sleep with (?:me|you)|my dick|dick pic|suck my|spread your legs|show (?:me|us) your (?:body|tits|boobs|breasts|ass|butt|pussy)|take off your (?:clothes|shirt|bra|pants|panties)|(?<![a-z])pussy|slut(?![a-z])|whore(?![a-z])|wanna bang|in bed with me|undress for",
        # Russian
        "голые фото|голая|голую|обнаж[её]нн(?:ая|ую)|переспать|трахн|трахать|(?<![а-я])секс|сиськ|раздевайся|разденься|покажи грудь|покажи (?:сиськи|попу|тело)|интим|минет|отсос[иё]|шлюх|проститутк|порно|возбужда(?:ешь|ет меня)",
        # German, Spanish, French
        "nacktfotos|nacktbilder|deine (?:titten|brüste)|ficken(?![a-z])|geile (?:schlampe|frau|titten)|schlampe(?![a-z])|fotos desnuda|chupame|quiero follar|photos nues|suce moi|coucher avec (?:moi|toi)",
    ],
}
#: words of the trade and reports of a complaint that hold parts of listed words
HARMLESS = r"grease nipples?|kill switch|dead ?band|cockpit|scunthorpe|cock valve|stripped|bitcoin|секстант|секстан|сексти|дурал\w+|судоку|dura\w*|идиотизм|to kill the engine|хохлом\w*|kanakin\w*|тварделл\w*"
