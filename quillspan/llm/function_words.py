"""Closed-class words of the languages that the crawl is expected to hold."""

# Articles, pronouns, prepositions, conjunctions, auxiliaries and the like.
ENGLISH = "the a an and or but nor so yet if because although though while whereas unless until since than that this these those which who whom whose whoever what whatever when whenever where wherever why how of to in on at by for from with without within into onto over under between among through during before after above below behind beside besides beyond near against about along around across despite as like is are was were be been being am do does did done have has had having will would shall should can could may might must not no neither either both each every some any all most more less few many much other another such same own only just even also too very then there here now again once never always often i you he she it we they me him her us them my your his its our their mine yours one ones somebody nobody anybody everybody nothing something anything up down out off back next until instead rather"
FRENCH = "le la les l un une des du de d et ou mais donc or ni car si que qui quoi dont où quand comme lorsque puisque quoique parce pour par sur sous dans en avec sans chez vers entre pendant depuis avant après devant derrière près contre à au aux ce cet cette ces ça cela celui celle ceux celles mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs je tu il elle on nous vous ils elles me te se lui y ne n pas plus moins très est sont était étaient fut furent être été a ont avait avaient eut avoir faut fait font tout toute tous toutes autre même aussi encore déjà puis ainsi"
SPANISH = "el la los las lo un una unos unas de del y e o u pero sino ni si que quien quienes cual cuales cuyo cuando como donde aunque porque pues mientras para por con sin en a al sobre bajo entre hasta desde hacia contra tras durante ante según este esta estos estas ese esa esos esas aquel aquella mi mis tu tus su sus nuestro nuestra yo tú él ella nosotros ellos ellas me te se le les nos no más menos muy ya aún es son era eran fue fueron ser sido está están estaba estaban hay ha han había hace falta todo toda todos todas otro otra mismo también así después"
GERMAN = "der die das den dem des ein eine einen einem einer eines und oder aber denn sondern weil obwohl dass daß ob wenn als wie wo wer wen wem wessen was welche welcher welches zu zum zur in im ins an am auf aus bei beim mit nach neben nicht noch nur nun von vom vor für gegen ohne über unter um durch bis seit während zwischen hinter ich du er sie es wir ihr man mich dich ihn uns euch ihm ihnen sich mein dein sein ihre unser euer dieser diese dieses jener jede jeder jedes ist sind war waren wurde wurden werden wird worden hat haben hatte hatten kann können muss müssen soll sollen braucht so sehr auch schon immer mehr weniger steht erst dann"
OTHERS = "il gli i di e è che non per con una uno della delle dei nel nella si da al alla o os as um uma uns umas do dos das e em no na nos nas que não por para com seu sua ele ela het een en van op dat niet met voor aan zijn er ook maar om te och det att som på är av för en ett till i og er på til og det"

FUNCTION_WORDS = frozenset(" ".join((ENGLISH, FRENCH, SPANISH, GERMAN, OTHERS)).split())
