"""Names that tell a person without any other cue (problem 2).

Frequent given names and surnames of the languages of the data, in lower case.
Names that are as often a word, a month or a place are apart: they count only
beside another name or after a cue.
"""

from __future__ import annotations

GIVEN = frozenset(
    """
    aaron abigail adam adrian adrien agnes agnès aisha alain alan albert alberto alejandra alejandro alessandro alexander alexandra alexandre alexei alfredo alice alicia alison
    álvaro amanda amélie amy ana anaïs andrea andreas andrés andrew ángela angela anita anja anke anna anne annette annie anthony antoine antonia antonio arnaud arthur astrid audrey
    barbara bärbel beate beatrice beatriz benedikt benjamin bernard bernd bernhard bettina birgit björn brandon brenda brian brigitte bruno camila carina carla carlos 
    carol carole caroline catalina catherine cecilia cécile cédric céline chantal charles chloe chloé christian christiane christina christine christoph christophe christopher claire
    claudia clemens clément clémence cornelia corinne cristina cynthia dagmar damien daniel daniela danielle david deborah denise diane didier diego dieter dietmar dirk dmitri
    dominik donald donna dorothea dorothy doris edith eduardo edward elena éléonore elisabeth elizabeth élise élodie emilia emilie émilie emily emma emmanuel enrique eric éric erik ernesto esteban
    esther ethan eugenia eva evelyn fabian fabien fabienne fatima felipe félix fernanda fernando florian franck françois françoise frank frédéric friedrich gabriel gabriela gabriele gaëlle
    geoffrey george georges gérard gerhard gisela giulia gonzalo gregory guillaume guillermo gustavo hannah hannes hans harald hassan heather heidi heike heinrich heinz helen helena hélène helga
    helmut henri herbert hervé holger hugo ibrahim ignacio ines inés inge ingrid irene isabel isabella isabelle ivan jacob jacqueline jacques jakob james janet janine jasmin javier jean jeanne
    jeffrey jennifer jérôme jessica joachim joanna johann johanna johannes john jonas jonathan jörg jorge josé josef joseph joshua juan juana juanita judith julian juliana julie julien juliette jürgen justin
    karen karin karl karla karsten katharina katherine kathleen kathrin katja katrin kenneth kevin kimberly klaus kristin kurt lars laura laurence laurent lauren léa leonard leonardo leonie leticia liam linda lisa lorena
    lorenzo louise luca lucas lucía lucie lucien ludovic luis luisa lukas lydia madeleine magdalena manfred manon manuel manuela marc marcel marcela marco marcos marcus margaret margarita maria maría mariana marianne
    marie mario marion markus marlene marta martha martina martín mathieu mathilde matthew matthias matthieu maurice mauricio maximilian megan melanie mélanie melissa michael michaela michel michèle miguel
    miriam mohamed mohammed monica mónica monika monique muhammad nadia nadine natalia natalie nathalie nathan nicholas nicolas nicole nicolás nils nina noah norbert nora océane olga oliver olivia olivier oscar óscar
    pablo pamela patricia patrick paul paula pauline pedro peter petra philip philipp philippe pierre priya rachel rafael rainer ralf ramón raphaël raúl raymond rebecca regina reinhard renate
    ricardo richard robert roberto rodrigo roger roland rolf ronald rosario roxane rüdiger rudolf ruth ryan sabine sabrina samantha samuel sandra sandrine sara sarah sébastien sebastian sergio sharon silke silvia
    simone solène sonja sophia sophie stefan stefanie stéphane stéphanie stephen stephanie steven susan susana susanne sven sylvie tamara tania tanja teresa theresa thérèse thierry thomas thorsten tobias
    tomás torsten udo ulrich ulrike ursula ute uwe valentina valérie vanessa véronique verónica vincent virginie viviane volker walter waltraud wendy werner wilhelm william wolfgang xavier ximena yannick yasmin yolanda yves yvonne
    """.split()
)

#: Given names that are also words, months, products or places.
SHARED = frozenset(
    """
    rosa marina gloria clara carmen claude julia salvador carolina pascal dominique camille diana
    alex alba amber april august aurora austin axel ben beth bill blanca bob brooke carl charlie charlotte chelsea chris clay consuelo crystal cruz dakota dan daisy dawn dolores don drew ed eli elsa ernst faith finn
    florence fleur frances francis franz georgia ginger grace grant guy harry harmony heather henry hope hunter iris ivy jack jade jake jane jasmine jay jim joe jordan josh joy june kate kay ken kim leo lena lily lou louis luke luz luna
    lucy madison mark martin mary matt max may mercedes mia mike miles nick nelson olive otto paloma paris parker pat pearl penny pia pilar ray rita robin rob rose ruby sam sandy santiago santos savannah scott sierra simon skip sofia
    sofía sol sky summer sydney ted theo tim tom tony toni tyler uli verena victor victoria viola violet virginia will willow zoe zoé anton emil ida karl mia lea li wei ming mei jun
    """.split()
)

SURNAMES = frozenset(
    """
    aguilar álvarez alvarez anderson andersson arnaud bauer baumann beaumont becker bernard bertrand blanchard bonnet brandt braun campbell carpentier castillo castro chevalier clark contreras cortés davies davis delgado
    díaz diaz dietrich domínguez dominguez dubois dufour dumont dupont dupuis durand edwards ernst espinoza evans fernández fernandez ferreira fischer flores fontaine fournier franke friedrich fuchs garcía garcia garnier garrido
    gauthier gautier gerard girard gomez gómez gonzales gonzález gonzalez graf groß guerrero guerin gupta gutiérrez gutierrez hall hansen harris hartmann heinrich henderson hernández hernandez herrera hoffmann hofmann horn hubert huber
    hughes iglesias ivanov jackson jäger jansen jensen jiménez jimenez johansson johnson jones jung kaiser kaufmann keller khan kim klein koch köhler kowalski kraus krause krüger kuhn kumar lambert lang lange
    lefebvre lefèvre legrand lehmann lemaire leroy lewis lopez lópez lorenz ludwig maier marchand marín marquez márquez martin martinez martínez mayer medina méndez mendez mendoza mercier meunier meyer miller mitchell molina
    möller moore morales moreau morel moreno morris morgan müller munoz muñoz murphy nelson neumann nguyen nicolas nuñez núñez ortega ortiz parker patel peña pérez perez perrin petit pfeiffer phillips pohl popescu ramírez ramirez ramos
    reyes richter rivera roberts robertson robinson rodríguez rodriguez rodrigues rojas romero rossi roth roussel rousseau roux ruiz sánchez sanchez sanders santos sauer schäfer schmid schmidt schmitt schmitz schneider scholz schröder
    schreiber schubert schulte schultz schulz schulze schumacher schuster schwarz seidel silva simon singh smirnov smith soto stein stewart suárez suarez tanaka taylor thompson torres tran turner vargas vasquez vázquez vega vidal villanueva vincent vogel vogt
    wagner walker walter watson weber weiß werner white williams wilson winkler winter wolf wolff wright yamamoto zimmermann
    """.split()
)

#: Surnames that are no word, place or given name: enough by themselves.
ONLY_SURNAMES = SURNAMES - SHARED - GIVEN - frozenset(
    """
    aguilar bauer becker braun campbell castillo castro contreras cortés espinoza evans fischer flores fontaine fuchs garnier garrido graf groß guerrero hall herrera horn iglesias jackson jäger jung kaiser kaufmann keller khan klein koch köhler lang lange
    legrand ludwig maier marchand medina mercier miller molina moore morales moreno morris morgan müller nelson ortega parker peña petit pohl ramos reyes richter rivera rojas romero roth roux santos sauer schäfer schmid schneider schreiber schubert schulze schumacher
    schuster schwarz silva simon singh stein stewart taylor torres turner vega vidal vogel vogt wagner walker walter weber weiß white winkler winter wolf wolff wright zimmermann durand roussel rousseau lambert davis clark lewis jones
    """.split()
)

#: Surnames that seldom begin any other word.
HAN_SURE = "赵钱孙李周吴郑王冯陈褚蒋沈韩杨朱秦许吕张孔曹严魏陶姜戚谢邹苏潘葛范彭鲁韦俞袁柳鲍唐薛雷贺倪汤滕殷罗郝邬傅卞顾孟黄穆萧尹姚邵汪祁臧戴宋庞熊屈董梁杜阮闵贾娄颜郭徐邱骆夏蔡樊胡霍虞柯卢莫裘邓洪崔龚程邢裴陆翁荀甄芮靳段侯宓刘詹叶黎蔺谭冉桑濮廖耿聂曾肖"
HAN_DOUBLE = "欧阳|司马|上官|诸葛|东方|皇甫|尉迟|公孙|慕容|司徒|令狐|夏侯|宇文|长孙|端木|独孤|南宫|西门|百里|轩辕"

#: Frequent words that stand where a name could, in texts that write names in lower case.
COMMON = frozenset(
    """
    the a an and or but not so to of in at on for my our your his her their this that these those it its i we you they he she me him us them is are was were be been being am do does did done have has had will would can could should may might must
    who what when where why how which if then than there here again please very too also just only even still yet already always never often sometimes usually mostly really quite rather pretty almost maybe perhaps probably actually finally recently soon later now today tomorrow yesterday
    all any some no none each every both either neither one two three few more most many much less least other another same such own new old good bad great nice fine best better worse big small little long short high low first last next early late ready busy free sure happy sad glad sorry tired sick afraid
    about after before with without from by into over under between through during against until while because since though although as like up down out off back away home work time day week month year way thing things people person someone anyone everyone nobody somebody anybody everybody others
    help advice directions information details permission support money food water coffee tea lunch dinner breakfast customers users team staff doctor mother father sister brother wife husband friend boss going trying looking getting making taking coming working thinking talking getting kind sort lot bit
    de la le les un une des et ou mais pas je tu il elle on nous vous ils elles que qui ce cette mon ma mes ton ta son sa ses notre votre leur très bien plus moins encore toujours jamais aussi déjà
    el los las una unos unas y o pero no yo él ella nosotros ellos que quien este esta mi mis tu tus su sus nuestro muy bien más menos siempre nunca también ya
    der die das den dem des ein eine einen einem einer und oder aber nicht ich du er sie es wir ihr mein meine dein sein unser sehr gut mehr weniger immer nie auch schon noch nur ganz
    """.split()
)
